"""Sinks: an index kept by signature, artifacts, logs, and contract-checked forecast tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.text import redact
from ..operators.relational import first_per_key

TOLERANCE = 1e-9


def signature(spark: SparkSession, glob: str, version: int = 1) -> str:
    """version:files:bytes:latest change, from metadata alone."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(glob).select("length", "modificationTime")
    r = f.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.max(F.unix_seconds("modificationTime")), F.lit(0))).first()
    return f"v{version}-{r[0]}-{r[1]}-{r[2]}"


def load_or_build(spark: SparkSession, folder: str, key: str, build) -> DataFrame:
    """The table kept under a signature, built and written where there is none or it cannot be read."""
    path = f"{folder.rstrip('/')}/{key}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        build().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def bucketed_index(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """Postings in files by a hash of the term, so that a query reads only its terms' buckets."""
    b = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    b.repartition("bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str, terms: list[str], buckets: int = 64) -> DataFrame:
    """Postings of some terms: partition pruning by bucket, then a pushed-down filter by term."""
    wanted = spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).distinct()
    return spark.read.parquet(path).where(F.col("bucket").isin([r[0] for r in wanted.collect()]) & F.col("term").isin(terms))


def write_artifact(df: DataFrame, path: str) -> None:
    """Rows as JSON objects, credentials masked."""
    df.select(redact(F.to_json(F.struct(*df.columns))).alias("value")).write.mode("overwrite").text(path)


def append_log(df: DataFrame, path: str, text_limit: int = 4000) -> None:
    """Appends records as JSON lines, texts masked and shortened."""
    cols: list[Column] = [redact(F.col(c), text_limit).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("append").json(path)


def contract_problems(values: DataFrame, spec: DataFrame, key: list[str]) -> DataFrame:
    """(key, problem): what keeps a table of values from being written: missing, unknown, other units, or no finite number."""
    s, v = spec.select(*key, F.col("units").alias("want"), F.lit(True).alias("in_spec")), values.select(*key, "units", "value", F.lit(True).alias("in_values"))
    j = s.join(v, key, "full")
    fine = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    why = F.when(F.col("in_spec").isNull(), "unknown").when(F.col("in_values").isNull(), "missing").when(~F.col("units").eqNullSafe(F.col("want")), "units").when(~fine, "value")
    return j.select(*key, why.alias("problem")).where("problem is not null")


def write_forecasts(values: DataFrame, spec: DataFrame, key: list[str], path: str) -> None:
    """Writes one file per ticker if the values keep the contract, and raises without writing if not."""
    bad = contract_problems(values, spec, key).limit(20).collect()
    if bad:
        raise ValueError("; ".join(" ".join(map(str, r)) for r in bad))
    values.repartition("ticker").write.mode("overwrite").partitionBy("ticker").json(path)


def verify_forecasts(written: DataFrame, values: DataFrame, key: list[str]) -> DataFrame:
    """Rows that were not written as they are: missing, or off by more than the tolerance."""
    w = written.select(*key, F.col("value").alias("written"))
    near = F.abs(F.col("value") - F.col("written")) <= F.greatest(F.lit(TOLERANCE), TOLERANCE * F.greatest(F.abs("value"), F.abs("written")))
    return values.join(w, key, "left").where(F.col("written").isNull() | ~near).select(*key, "value", "written")


def cached_by_content(df: DataFrame, cache: DataFrame, content: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with an answer, rows without): answers are kept under the hash of the columns that determine them."""
    key = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in content]), 256)
    k = df.withColumn("cache_key", key)
    one = first_per_key(cache.select("cache_key", "answer"), ["cache_key"], [F.asc("answer")])
    return k.join(one, "cache_key"), k.join(one, "cache_key", "left_anti")
