"""Helpers shared by the operators: text keys, durable intermediate tables, repeated rows, hot keys."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: White space that does not count at the ends of a key: Python's str.strip() set that occurs in data, no-break space included.
BLANKS = " \t\n\r\f\v\u00a0"

#: A key is hot if it holds this share of a table's rows or more, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 200
#: Below this many rows a table is one small task's work and no key of it is split.
HOT_MIN_ROWS = 200_000
SALTS = 32


def strip(c: Column | str) -> Column:
    """The text without outer white space."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))


def norm_key(c: Column | str) -> Column:
    """A text key as it is compared: no outer white space, lower case; null where nothing is left."""
    k = F.lower(strip(c))
    return F.when(k != "", k)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for costly work on rows of few, unsplittable files.

    A scan that has enough partitions already, as any large table's has, stays where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the one the session names, else a fresh local one (tests).

    Without a named folder a cluster is refused: each of its executors would write to a disk of its own.
    """
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tideline-")
        spark.sparkContext.setCheckpointDir(base)
        atexit.register(shutil.rmtree, base, True)
        base = spark.sparkContext.getCheckpointDir() or base
    return base.rstrip("/")


def durable(df: DataFrame, tag: str = "t") -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and returns a reader of it.

    The rows survive the loss of any executor, since no executor keeps them.
    """
    path = f"{work_dir(df.sparkSession)}/tideline-{tag}-{uuid.uuid4().hex}"
    for held in _scratch:
        held.append(path)
    df.write.parquet(path)
    if path.startswith(("/", "file:")):
        atexit.register(shutil.rmtree, os.path.abspath(path.removeprefix("file:").replace("///", "/").replace("//", "/")), True)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The tables written inside each open scratch().
_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the intermediate tables written inside of it when it ends, on whatever file system they are.

    A query's result must have been written or collected by then.
    """
    _scratch.append(paths := [])
    try:
        yield
    finally:
        _scratch.remove(paths)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        for p in paths:
            f = hadoop(p)
            f.getFileSystem(spark._jsc.hadoopConfiguration()).delete(f, True)


def once_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row per key, null keys dropped; of rows that differ the least by their columns in order of name, nulls first.

    Only the key column is read to learn whether any key repeats; where none does (the usual case) the rows stay
    where they are and nothing wide is shuffled.
    """
    df = df.where(F.col(key).isNotNull())
    repeated = df.groupBy(key).count().where("count > 1").select(key)
    if repeated.isEmpty():
        return df
    single = df.join(repeated, key, "left_anti")
    others = sorted(c for c in df.columns if c != key)
    if not others:
        return df.distinct()
    least = df.join(repeated, key, "left_semi").groupBy(key).agg(F.min(F.struct(*others)).alias("_least"))
    return single.unionByName(least.select(key, "_least.*").select(single.columns))


#: A side of a join of at most this many narrow rows is broadcast; the rows are counted before.
MAX_BROADCAST_ROWS = 200_000


def sized_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined to right, which must be a written table of narrow rows: broadcast if counted small, else shuffled."""
    return left.join(F.broadcast(right) if right.count() <= MAX_BROADCAST_ROWS else right, keys, how)


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, min_rows: int | None = None) -> list:
    """Keys that hold at least `share` of the rows, hence at most 1 / share of them; none in a table under min_rows, HOT_MIN_ROWS if not given."""
    n = df.count()
    if n < (HOT_MIN_ROWS if min_rows is None else min_rows):
        return []
    rows = df.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") >= n * share).collect()
    return [r[0] for r in rows]


def salt(key: Column, hot: list, spread: Column, n: int = SALTS) -> Column:
    """The part that a row goes to: a hash of spread where its key is hot, else 0."""
    return F.when(key.isin(hot), F.pmod(F.xxhash64(spread), F.lit(n)).cast("int")).otherwise(F.lit(0)) if hot else F.lit(0)


def salts(key: Column, hot: list, n: int = SALTS) -> Column:
    """All parts of a key."""
    return F.when(key.isin(hot), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0))) if hot else F.array(F.lit(0))


def salted_join(left: DataFrame, right: DataFrame, key: str, on, how: str, spread: Column, parts: int = SALTS, hot: list | None = None) -> DataFrame:
    """left joined to right on equal `key` and the condition on(left, right), hot keys of left split into `parts` parts.

    Rows of a hot key go to part hash(spread) of left; right's few rows of that key are copied to every part. how is
    any of inner, left, left_semi, left_anti.
    """
    hot = hot_keys(left.select(key), key) if hot is None else hot
    lhs, rhs = left.withColumn("_salt", salt(F.col(key), hot, spread, parts)), right.withColumn("_salt", F.explode(salts(F.col(key), hot, parts)))
    cond = (lhs[key] == rhs[key]) & (lhs["_salt"] == rhs["_salt"])
    extra = on(lhs, rhs)
    out = lhs.join(rhs, cond if extra is None else cond & extra, how)
    return out.drop(lhs["_salt"]) if how in ("left_semi", "left_anti") else out.drop(lhs["_salt"]).drop(rhs["_salt"]).drop(rhs[key])
