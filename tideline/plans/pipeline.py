"""The forecast pipeline as one plan: guard, passages, candidates, series, replay, guidance, ensemble and checks for all companies."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import candidates as C
from ..operators import forecast as L
from ..operators import quality as M
from ..operators import timeseries as S
from ..operators.asof import anchors_with_dates
from ..operators.common import durable, spread, table
from ..operators.pit import CUTOFF, Corpus, PointInTime
from ..operators.relational import first_per_key
from ..operators.texts import chunks


def passages(spark, sf_dir, known: PointInTime) -> DataFrame:
    """The visible documents' chunks and the visible contexts of value_candidates, all of one score: a filing is read as a whole."""
    d = known.documents().where("text is not null").select(F.struct("company_slug", "doc_id").alias("of"), "text")
    parts = chunks(spread(d), "of").select("of.company_slug", "of.doc_id", F.col("ordinal").cast("long").alias("ordinal"), "text")
    c = table(spark, sf_dir, "value_candidates").select("candidate_id", "source_path", "context").distinct()
    said = c.join(_paths(known), "source_path").select("company_slug", "doc_id", (-F.col("candidate_id")).alias("ordinal"), F.col("context").alias("text"))
    return parts.unionByName(said).withColumn("score", F.lit(1.0))


def guidance_passages(spark, sf_dir, known: PointInTime) -> DataFrame:
    """The sentences of expectation in the visible documents and in the visible anchors' contexts."""
    said = lambda c: F.posexplode(N.guiding_sentences(F.col(c))).alias("ordinal", "text")
    d = spread(known.documents().where("text is not null").select("doc_id", "company_slug", "text")).select("company_slug", "doc_id", said("text"))
    a = table(spark, sf_dir, "guidance_anchors").select("anchor_id", "source_path", "context").distinct()
    a = a.join(_paths(known), "source_path").select("company_slug", "doc_id", "anchor_id", said("context"))
    return d.withColumn("ordinal", F.col("ordinal").cast("long")).unionByName(a.withColumn("ordinal", -F.col("anchor_id")).drop("anchor_id")).withColumn("score", F.lit(1.0))


def _paths(known: PointInTime) -> DataFrame:
    return known.documents().select("doc_id", "company_slug", F.col("rel_path").alias("source_path")).distinct()


def _now(points: DataFrame, as_of: date) -> DataFrame:
    return points.select("key").distinct().select("key", F.lit(as_of).alias("event"), F.lit(as_of).alias("cutoff"))


def document_estimates(spark, sf_dir, known: PointInTime) -> tuple[DataFrame, DataFrame]:
    """(key, value, method, confidence, observations) and (key, last) per company and metric, key being both.

    Each filing's best candidate is a point of the series, whose replay is blended with the newest guidance after its
    measured bias; a metric without a series has the median of the agreeing candidates of all passages.
    """
    key = F.concat_ws("|", "company_slug", "metric").alias("key")
    specs, d = C._specs(spark, sf_dir).distinct(), known.documents().drop("text")
    found = durable(C.candidates(passages(spark, sf_dir, known), specs, None), "candidates")
    filings = C.series_filings(d).select("doc_id", "published_at").distinct()
    s = C.build_series(found.join(filings.select("doc_id"), "doc_id", "left_semi"), filings)
    points = durable(s.where("not is_guidance").groupBy(key, F.col("published_at").alias("day")).agg(F.max("value").alias("value")), "points")
    g = C.candidates(guidance_passages(spark, sf_dir, known), specs, None).join(d.select("doc_id", F.col("published_at").alias("day")).distinct(), "doc_id").select(key, "day", "value", "score", "doc_id", "rank")
    guided = durable(first_per_key(g, ["key", "day"], [F.desc("score"), F.asc("doc_id"), F.asc("rank")]).select("key", "day", "value"), "guided")
    factor = S.bias(points, guided).select("key", L.bias_factor(F.col("observations"), F.col("median_surprise")).alias("factor"))
    e = L.replay(points, _now(points, known.cutoff)).join(S.latest(guided).select("key", F.col("value").alias("said")), "key", "left").join(factor, "key", "left")
    e = e.withColumn("value", L.blend(F.col("forecast"), F.col("said") * F.coalesce("factor", F.lit(1.0))))
    guides = ~F.col("value").eqNullSafe(F.col("forecast"))
    e = e.select("key", "value", F.when(guides, F.concat(F.lit("guidance and "), F.col("method"))).otherwise(F.col("method")).alias("method"), F.when(guides, "medium").otherwise(F.col("confidence")).alias("confidence"), "observations")
    rest = C.corroborated(found).select(key, "value", F.lit("corroborated").alias("method"), F.when(F.col("agreeing") >= 3, "medium").otherwise("low").alias("confidence"), F.col("agreeing").alias("observations"))
    return e.unionByName(rest.join(e.select("key"), "key", "left_anti")), S.latest(points).select("key", F.col("value").alias("last"))


def anchor_estimates(spark, sf_dir, known: PointInTime) -> tuple[DataFrame, DataFrame]:
    """(key, value, method, confidence, observations) and (key, last): every series of anchors with a value, from what the cutoff allows.

    A series is its anchors by publication day, the last captured of a day.
    """
    a = table(spark, sf_dir, "guidance_anchors")
    v = a.groupBy("anchor_id").agg(F.min("value").alias("value"))
    p = anchors_with_dates(a, known.documents()).join(v, "anchor_id").where("value is not null and pub is not null").select(F.col("series_id").alias("key"), F.to_date("pub").alias("day"), "value", "cap", "anchor_id")
    p = first_per_key(p.where(F.col("day") <= F.lit(known.cutoff)), ["key", "day"], [F.desc("cap"), F.desc("anchor_id")]).select("key", "day", "value")
    points = durable(p, "anchors")
    return L.replay(points, _now(points, known.cutoff)).withColumnRenamed("forecast", "value"), S.latest(points).select("key", F.col("value").alias("last"))


def run(spark, sf_dir, as_of: date = CUTOFF) -> DataFrame:
    """The estimate, its method, and the worst of its checks: a row per series of anchors, and one, with a null key, per metric of a company without one.

    A row's members are the replay of its anchors and the estimate from its company's documents; a row without either
    has no forecast and fails the check of completeness.
    """
    known = Corpus.load(spark, sf_dir).as_of(as_of)
    spec = table(spark, sf_dir, "company_metrics")
    own = table(spark, sf_dir, "guidance_anchors").where("series_id is not null").groupBy(F.col("series_id").alias("key")).agg(F.min("ticker").alias("ticker"), F.min("metric").alias("metric"), F.min("units").alias("units"))
    own = own.join(spec.groupBy("ticker").agg(F.min("company_slug").alias("company_slug")), "ticker", "left").drop("ticker")
    rest = spec.groupBy("company_slug", "metric").agg(F.min("units").alias("units")).join(own, ["company_slug", "metric"], "left_anti").withColumn("key", F.lit(None).cast("long"))
    rows = own.unionByName(rest).withColumn("pair", F.concat_ws("|", "company_slug", "metric"))
    rows = durable(rows.withColumn("id", F.coalesce(F.col("key").cast("string"), "pair")), "rows")
    (de, dl), (ae, al) = document_estimates(spark, sf_dir, known), anchor_estimates(spark, sf_dir, known)
    from_documents = rows.join(de.withColumnRenamed("key", "pair"), "pair").withColumn("source", F.lit("documents"))
    members = from_documents.unionByName(rows.join(ae, "key").select(*rows.columns, "value", "method", "confidence", "observations", F.lit("anchors").alias("source")))
    members = durable(members.select("id", "source", "value", "method", "confidence", "observations"), "members")
    e = L.ensemble(members, ["id"]).select("id", F.col("value").alias("forecast"), "agreement")
    m = members.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("method")), ", ").alias("method"), F.max(F.col("confidence") == "medium").alias("medium"), F.sum("observations").alias("observations"))
    e = durable(rows.join(e, "id", "left").join(m, "id", "left"), "estimates")
    last = rows.join(dl.select(F.col("key").alias("pair"), F.col("last").alias("d")), "pair", "left").join(al.select("key", F.col("last").alias("a")), "key", "left").select("id", F.coalesce("d", "a").alias("last"))
    worst = M.rollup(M.checks(e.select("id", "metric", "units", F.col("forecast").alias("value")), last), ["id"]).select("id", "worst")
    sure = F.when(F.col("medium") & (F.col("agreement") != "wide"), "medium").otherwise("low")
    return e.join(worst, "id").select("key", "company_slug", "metric", F.round("forecast", 6).alias("forecast"), F.coalesce("method", F.lit("none")).alias("method"), sure.alias("confidence"), F.coalesce("observations", F.lit(0)).alias("observations"), "worst")


def backtest(spark, sf_dir, n_events: int = 8) -> DataFrame:
    """Errors of replayed forecasts of every series of candidates' values, under cutoffs before each event."""
    d = table(spark, sf_dir, "documents")
    found = C.candidates(C._hits(spark, sf_dir), C._specs(spark, sf_dir), None)
    s = C.build_series(found, d).where("published_at is not null")
    p = s.groupBy(F.concat_ws("|", "company_slug", "metric").alias("key"), F.col("published_at").alias("day")).agg(F.max("value").alias("value"))
    points = durable(p, "points")
    o = L.replay(points, L._events(points, n_events)).join(points.select("key", F.col("day").alias("event"), F.col("value").alias("actual")), ["key", "event"])
    return L.summarise(o, ["key"])


def pipeline_run(spark, sf_dir):
    return run(spark, sf_dir)


def pipeline_backtest(spark, sf_dir):
    return backtest(spark, sf_dir)


QUERIES = {f.__name__: f for f in (pipeline_run, pipeline_backtest)}
ORACLES: dict[str, str] = {}
