"""Problem 6: quantities recorded in different units.

A multi-pattern automaton finds unit aliases in the units field or, failing that, next to the number in the text;
the longest match and the metric's family decide; the conversion factors, a table of fixed size, are broadcast.

Defined results: a row is left out if its value is null, not finite, or in units nobody states; a percentage metric in
money (or the reverse) is not convertible; a unit's stated currency other than the common one is not convertible; an
amount of money with a currency and no scale word is in single units; repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import unit_text as U
from .common import durable, norm_key, salted_join, table

#: Two values agree if they differ by at most this part of the larger magnitude.
TOLERANCE = 0.0005


def factors(spark: SparkSession) -> DataFrame:
    """(unit, factor): the fixed conversion table."""
    return spark.createDataFrame(sorted(U.FACTORS.items()), "unit string, factor double")


def common_units(metrics: DataFrame) -> DataFrame:
    """(tk, metric_key, family, currency, common_factor): the units each company's metric is converted to, one row per key."""
    u = F.col("units")
    quantities = {x: (dimension, factor) for dimension, of in U.QUANTITIES.items() for _, factor, names in of for x in names if x != "m"}
    dimension = F.create_map(*[F.lit(x) for k, (d, _) in quantities.items() for x in (k, d)])[F.lower(u)]
    size = F.create_map(*[F.lit(x) for k, (_, f) in quantities.items() for x in (k, f)])[F.lower(u)]
    family = F.when(u == "%", "percent").when(u.contains("share") | (u == "GBp"), "share").otherwise(F.coalesce(dimension, F.lit("money")))
    plain = F.when(dimension.isNotNull(), size).when(u == "GBp", 0.01).when(u.endswith("bn"), 1e9).when(u.endswith("m") & ~u.contains("share"), 1e6).when(u.endswith("k"), 1e3).otherwise(1.0)
    rows = metrics.select(norm_key("ticker").alias("tk"), norm_key("metric").alias("metric_key"), family.alias("family"), "currency", plain.alias("common_factor"))
    return rows.where("tk is not null and metric_key is not null").dropDuplicates(["tk", "metric_key"])


def ticker_key(c: str) -> Column:
    """A ticker without exchange prefix, as compared."""
    return F.element_at(F.split(norm_key(c), ":"), -1)


def rows_with_units(rows: DataFrame, metrics: DataFrame) -> DataFrame:
    """(id, doc_key, metric_key, value, currency, common_factor, unit): figures of known metrics with the unit found for each, or null.

    rows: id bigint, ticker, metric, doc, value, units, raw, text, scale, currency_mark, is_percent, is_pence.
    company_metrics has a fixed size and is broadcast.
    """
    known = F.broadcast(common_units(metrics))
    r = rows.select(
        "id", norm_key("doc").alias("doc_key"), ticker_key("ticker").alias("tk"), norm_key("metric").alias("metric_key"),
        "value", "units", "raw", "text", "scale", "currency_mark", "is_percent", "is_pence",
    ).where("id is not null and doc_key is not null and value is not null and not isnan(value) and abs(value) < double('infinity')")
    r = r.join(known, ["tk", "metric_key"])
    keep = ("id", "doc_key", "metric_key", "value", "currency", "common_factor")
    r = r.withColumn("row", F.struct(*keep)).select("row", "value", "family", "units", "raw", "text", "scale", "currency_mark", "is_percent", "is_pence")
    row_type = r.schema["row"].dataType.simpleString()
    return r.mapInArrow(_resolve, f"row {row_type}, unit string").select("row.*", "unit")


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict = {}
    for b in batches:
        cols = {n: b.column(n).to_pylist() for n in ("value", "family", "units", "raw", "text", "scale", "currency_mark", "is_percent", "is_pence")}
        out = []
        if len(memo) > 200_000:
            memo.clear()
        for value, family, units, raw, text, scale, mark, is_percent, is_pence in zip(*cols.values(), strict=True):
            key = (units, family)
            if (unit := memo.get(key, 0)) == 0:
                unit = memo[key] = U.of_units(units, family)
            if unit is None and raw is not None:
                key = (U.NUMBER.sub("1", raw), family, 1)
                if (unit := memo.get(key, 0)) == 0:
                    m = U.NUMBER.search(key[0])
                    unit = memo[key] = U.near_number(key[0], 1.0, family) if m else None
            bare = unit is None or unit.startswith("money:unit")
            stated = unit is not None and units is not None and units.strip() != ""
            if bare and not stated and family == "money" and scale:
                if more := U.of_units(scale, family):
                    unit = more if unit is None else f"money:{more.split(':')[1]}:{unit.split(':')[2]}"
                    bare = False
            if bare and not stated:
                if raw is None:
                    unit = U.near_number(text, value, family) or unit
                elif more := U.declared(text, family):
                    unit = more
                elif unit is None:
                    unit = U.near_number(text, value, family)
            if unit is None:
                if family == "percent" and scale:
                    unit = U.of_units(scale, family)
                if unit is None and family == "percent" and is_percent:
                    unit = "percent:unit:"
                elif unit is None and family == "share" and is_pence:
                    unit = "share:hundredth:GBP"
                elif unit is None and mark:
                    unit = U.of_units(mark, family)
            out.append(unit)
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out, pa.string())], names=["row", "unit"])


def convert(rows: DataFrame, metrics: DataFrame) -> DataFrame:
    """(id, doc_key, metric_key, common_value) of rows whose value converts to the common units; the factors are a fixed table."""
    parts = F.split("unit", ":")
    u = rows_with_units(rows, metrics).where("unit is not null")
    u = u.select("id", "doc_key", "metric_key", "value", "currency", "common_factor", F.concat_ws(":", parts[0], parts[1]).alias("unit"), parts[2].alias("stated"))
    u = u.where("stated = '' or stated = currency").join(F.broadcast(factors(rows.sparkSession)), "unit")
    return u.select("id", "doc_key", "metric_key", (F.col("value") * F.col("factor") / F.col("common_factor")).alias("common_value")).distinct()


def unresolved(rows: DataFrame, metrics: DataFrame) -> DataFrame:
    """(id, reason) of the rows that convert() leaves out: no value, no such metric, no unit found, or another currency."""
    known = F.broadcast(common_units(metrics).select("tk", "metric_key").withColumn("known", F.lit(True)))
    fine = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    r = rows.where("id is not null").withColumn("tk", ticker_key("ticker")).withColumn("metric_key", norm_key("metric")).join(known, ["tk", "metric_key"], "left")
    before = r.select("id", F.when(~fine, "no value").when(norm_key("doc").isNull(), "no document").when(F.col("known").isNull(), "no such metric").alias("reason"))
    stated = F.split("unit", ":")[2]
    after = rows_with_units(rows, metrics).select("id", F.when(F.col("unit").isNull(), "no unit").when((stated != "") & (stated != F.col("currency")), "other currency").alias("reason"))
    return before.unionByName(after).where("reason is not null").distinct()


def evidence_rows(ev: DataFrame) -> DataFrame:
    no = lambda t: F.lit(None).cast(t)
    return ev.select(
        F.col("evidence_id").alias("id"), "ticker", "metric", F.col("source").alias("doc"), "value", "units", no("string").alias("raw"), F.col("claim").alias("text"),
        no("string").alias("scale"), no("string").alias("currency_mark"), no("boolean").alias("is_percent"), no("boolean").alias("is_pence"))


def candidate_rows(vc: DataFrame) -> DataFrame:
    return vc.select(
        F.col("candidate_id").alias("id"), "ticker", "metric", F.col("source_path").alias("doc"), "value", "units", "raw", F.col("context").alias("text"),
        "scale", F.col("currency").alias("currency_mark"), "is_percent", "is_pence")


def matches(candidates: DataFrame, evidence: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(candidate_id, evidence_id): same document, metric and sign, values within tolerance.

    Values are put into bands on a logarithmic scale wider than the tolerance, candidates also into both neighbours,
    so only rows of about the same value ever meet, however many share a document and metric.
    """
    width = 4 * tolerance
    v = F.col("common_value")
    band = F.when(v == 0, F.lit(None).cast("long")).otherwise(F.floor(F.log(F.abs(v)) / F.lit(width)).cast("long"))
    key = lambda b: F.concat_ws("\x1f", "doc_key", "metric_key", F.signum(v).cast("int").cast("string"), F.coalesce(b.cast("string"), F.lit("0")))
    c = candidates.select(F.col("id").alias("candidate_id"), F.col("common_value").alias("cv"), "doc_key", "metric_key", "common_value", F.explode(F.when(v == 0, F.array(F.lit(0).cast("long"))).otherwise(F.array(band - 1, band, band + 1))).alias("band"))
    c = c.select("candidate_id", "cv", key(F.when(v != 0, F.col("band"))).alias("k"))
    e = evidence.select(F.col("id").alias("evidence_id"), v.alias("ev"), key(band).alias("k"))
    on = lambda a, b: F.abs(a["ev"] - b["cv"]) <= F.lit(tolerance * (1 + 1e-12)) * F.greatest(F.abs(a["ev"]), F.abs(b["cv"]))
    e = durable(e, "figures")  # read twice, to count its keys and to join
    return salted_join(e, c, "k", on, "inner", spread=F.col("evidence_id")).select("candidate_id", "evidence_id").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = table(spark, sf_dir, "company_metrics")
    return matches(convert(candidate_rows(table(spark, sf_dir, "value_candidates")), metrics), convert(evidence_rows(table(spark, sf_dir, "evidence")), metrics))


def p6_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every figure that converts, in the common units of its company's metric."""
    metrics = table(spark, sf_dir, "company_metrics")
    ev = convert(evidence_rows(table(spark, sf_dir, "evidence")), metrics).select(F.lit("evidence").alias("table_name"), "id", "metric_key", F.round("common_value", 9).alias("common_value"))
    vc = convert(candidate_rows(table(spark, sf_dir, "value_candidates")), metrics).select(F.lit("value_candidates").alias("table_name"), "id", "metric_key", F.round("common_value", 9).alias("common_value"))
    return ev.unionByName(vc)


def p6_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many figures of each table and metric were not converted, and why."""
    metrics, parts = table(spark, sf_dir, "company_metrics"), []
    for name, rows in (("evidence", evidence_rows(table(spark, sf_dir, "evidence"))), ("value_candidates", candidate_rows(table(spark, sf_dir, "value_candidates")))):
        bad = unresolved(rows, metrics)
        parts.append(bad.groupBy("reason").agg(F.countDistinct("id").alias("figures")).select(F.lit(name).alias("table_name"), "reason", "figures"))
    return parts[0].unionByName(parts[1])


QUERIES = {"p6_found": p6_found, "p6_converted": p6_converted, "p6_unresolved": p6_unresolved}
ORACLES: dict[str, str] = {}
