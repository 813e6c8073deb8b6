"""Problem 2: references to rows that do not exist.

Every change of a referenced table is a signed delta of its key's existence (+1 when a version arrives, -1 when it is
withdrawn), every referring row a delta of the key's references. Running sums of the deltas give the key's existence
at any moment; keys with positive references and zero existence are orphans, at the moment of the reference
(orphan_rows) or at present (OrphanCounts, which is kept up to date from batches of deltas).

Defined results: null and blank references are never orphans; a referring row without a moment is one, since nothing
is known to exist at an unknown moment; a version without arrival, or withdrawn no later than it arrived, never
existed; repeated rows count once; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, hot_keys, norm_key, salt, salts, table, work_dir

#: (referring table, its row key, its reference, its moment, the referenced table, the referenced key)
REFERENCES = (
    ("tasks", "task_id", "run_id", "started_at", "runs", "run_id"),
    ("run_events", "event_id", "task_id", "ts", "tasks", "task_id"),
    ("evidence", "evidence_id", "task_id", "ts", "tasks", "task_id"),
)

DAY_MICROS = 86_400_000_000


def existence_deltas(parents: DataFrame, key: str, born: str = "loaded_at", died: str = "deleted_at") -> DataFrame:
    """(k, t, d): net change of the existence count of key k at moment t."""
    p = parents.select(norm_key(key).alias("k"), F.col(born).alias("b"), F.col(died).alias("e"))
    p = p.where("k is not null and b is not null and (e is null or e > b)")
    both = F.array(F.struct(F.col("b").alias("t"), F.lit(1).alias("d")), F.struct(F.col("e").alias("t"), F.lit(-1).alias("d")))
    return p.select("k", F.inline(both)).where("t is not null").groupBy("k", "t").agg(F.sum("d").alias("d")).where("d <> 0")


def orphan_rows(children: DataFrame, row_key: str, ref: str, moment: str, parents: DataFrame, key: str) -> DataFrame:
    """(row_key, k, moment): rows of children whose key has positive references and zero existence at their moment.

    Deltas of existence and references stand in one table, ordered by moment. The running sum of existence is taken in
    two steps: over days, whose sums enter the next day as an opening delta, and inside a day, so no key's history is
    sorted in one piece. References of a hot key are split; the few deltas of its existence go to every part.
    """
    micros = lambda c: F.unix_micros(c).alias("t")
    day = F.floor(F.col("t") / F.lit(DAY_MICROS)).alias("day")
    refs = children.select(F.col(row_key).cast("string").alias("row_key"), norm_key(ref).alias("k"), F.col(moment).alias("moment")).where("k is not null")
    dated = refs.where("moment is not null").select("k", micros("moment"), "row_key", "moment")
    exist = existence_deltas(parents, key).select("k", micros("t"), "d")
    sums = exist.groupBy("k", day).agg(F.sum("d").alias("s")).unionByName(dated.select("k", day).distinct().withColumn("s", F.lit(0).cast("long"))).groupBy("k", "day").agg(F.sum("s").alias("s"))
    before = F.sum("s").over(Window.partitionBy("k").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    opening = sums.select("k", (F.col("day") * F.lit(DAY_MICROS)).alias("t"), before.alias("d")).where("d <> 0")
    hot = hot_keys(dated.select("k"), "k")
    part, parts = salt(F.col("k"), hot, F.col("row_key")), salts(F.col("k"), hot)
    none = lambda kind: F.lit(None).cast(kind)
    # an opening delta holds from the very start of its day, before those of that moment; sums do not care for the order
    changes = exist.unionByName(opening).withColumn("part", F.explode(parts)).select("k", day, "part", "t", "d", none("string").alias("row_key"), none("timestamp").alias("moment"))
    both = changes.unionByName(dated.select("k", day, part.alias("part"), "t", F.lit(0).cast("long").alias("d"), "row_key", "moment"))
    running = F.sum("d").over(Window.partitionBy("k", "day", "part").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumn("exists", running).where("row_key is not null and exists = 0").select("row_key", "k", "moment")
    return found.unionByName(refs.where("moment is null").select("row_key", "k", "moment")).distinct()


def all_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans of every reference of REFERENCES: table_name, row_key, k, moment."""
    parts = []
    for child, row_key, ref, moment, parent, key in REFERENCES:
        rows = orphan_rows(table(spark, sf_dir, child), row_key, ref, moment, table(spark, sf_dir, parent), key)
        parts.append(rows.select(F.lit(child).alias("table_name"), "row_key", "k", "moment"))
    return reduce(DataFrame.unionByName, parts)


def _live(deleted: Column | None) -> Column:
    return F.lit(1) if deleted is None else F.when(deleted.isNull(), 1).otherwise(0)


def current_deltas(children: DataFrame, row_key: str, ref: str, parents: DataFrame, key: str) -> DataFrame:
    """(k, refs, exist): signed deltas that lead from nothing to the present state, combined per key.

    Versions of one referring row count as one reference, withdrawn rows as none. A hot key arrives as one partial
    row per input split.
    """
    dead = F.col("deleted_at") if "deleted_at" in children.columns else None
    refs = (
        children.select(F.col(row_key).cast("string").alias("r"), norm_key(ref).alias("k"), _live(dead).alias("d"))
        .where("k is not null").groupBy("r", "k").agg(F.min("d").alias("refs"))
        .select("k", "refs", F.lit(0).alias("exist"))
    )
    exist = parents.select(norm_key(key).alias("k"), F.lit(0).alias("refs"), _live(F.col("deleted_at")).alias("exist")).where("k is not null")
    return refs.unionByName(exist).groupBy("k").agg(F.sum("refs").alias("refs"), F.sum("exist").alias("exist"))


def reported(counts: DataFrame) -> DataFrame:
    """(k, refs): keys with positive references and zero existence."""
    return counts.where("refs > 0 and exist = 0").select("k", "refs")


class OrphanCounts:
    """Signed reference and existence counts per key, kept in a folder that all executors share.

    Every batch of deltas is one sub-folder with a row per key that it changes; the state is their sum. A batch that is
    written again replaces itself, so a retried batch counts once. compact() folds all batches so far into one.
    """

    SCHEMA = "k string, refs long, exist long"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def update(self, deltas: DataFrame, batch_id: int) -> None:
        """deltas: k, refs, exist, the changes of both counts, any number of rows a key."""
        d = deltas.groupBy("k").agg(F.sum("refs").alias("refs"), F.sum("exist").alias("exist")).where("refs <> 0 or exist <> 0")
        d.write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")

    def follow(self, deltas: DataFrame, checkpoint: str):
        """A running query that keeps the counts from a stream of deltas."""
        return deltas.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).start()

    def counts(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder).groupBy("k").agg(F.sum("refs").alias("refs"), F.sum("exist").alias("exist"))

    def current(self) -> DataFrame:
        return reported(self.counts())

    def compact(self, into: str) -> OrphanCounts:
        """The same counts in a new folder, keys at zero left out; the old folder may be deleted afterwards."""
        out = OrphanCounts(self.spark, into)
        out.update(self.counts(), -1)
        return out


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_orphans(spark, sf_dir).select("table_name", "row_key").distinct()


def p2_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table and month of their moment."""
    month = F.date_format(F.col("moment"), "yyyy-MM")
    return all_orphans(spark, sf_dir).groupBy("table_name", month.alias("month")).agg(F.countDistinct("row_key").alias("orphans"))


def p2_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys referred to now without a live row, per referring table, with the number of referring rows."""
    parts = []
    for child, row_key, ref, _, parent, key in REFERENCES:
        rows = reported(current_deltas(table(spark, sf_dir, child), row_key, ref, table(spark, sf_dir, parent), key))
        parts.append(rows.select(F.lit(child).alias("table_name"), F.col("k").alias("missing_key"), "refs"))
    return reduce(DataFrame.unionByName, parts)


def p2_maintained(spark: SparkSession, sf_dir: str, batches: int = 3) -> DataFrame:
    """p2_current from counts that were kept batch by batch; one batch is given twice, as after a failure, and the state compacted."""
    parts = []
    for child, row_key, ref, _, parent, key in REFERENCES:
        deltas = durable(current_deltas(table(spark, sf_dir, child), row_key, ref, table(spark, sf_dir, parent), key), "deltas")
        kept = OrphanCounts(spark, f"{work_dir(spark)}/tideline-orphans-{uuid.uuid4().hex}")
        for i in [*range(batches), batches - 1]:
            # references and existence of one key arrive in different batches
            late = F.pmod(F.xxhash64("k"), F.lit(batches))
            mine = deltas.select("k", "refs", F.lit(0).alias("exist")).where(late == i).unionByName(deltas.select("k", F.lit(0).alias("refs"), "exist").where((late + 1) % batches == i))
            kept.update(mine, i)
        kept = kept.compact(f"{kept.folder}-compact")
        parts.append(kept.current().select(F.lit(child).alias("table_name"), F.col("k").alias("missing_key"), "refs"))
    return reduce(DataFrame.unionByName, parts)


QUERIES = {"p2_found": p2_found, "p2_monthly": p2_monthly, "p2_current": p2_current, "p2_maintained": p2_maintained}

#: norm_key() in the oracle's dialect.
KEY_SQL = "nullif(lower(trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160))), '')"
_KEY = KEY_SQL


def _found_sql() -> str:
    parts = [
        f"select distinct '{c}' as table_name, cast({r} as varchar) as row_key, {m} as moment from {c} where {_KEY.format(c=ref)} is not null and not exists "
        f"(select 1 from {p} q where {_KEY.format(c='q.' + k)} = {_KEY.format(c=c + '.' + ref)} and q.loaded_at <= {c}.{m} and (q.deleted_at is null or q.deleted_at > {c}.{m}))"
        for c, r, ref, m, p, k in REFERENCES
    ]
    return " union all ".join(parts)


def _current_sql() -> str:
    parts = []
    for c, r, ref, _, p, k in REFERENCES:
        live = "deleted_at is null" if c == "tasks" else "true"
        parts.append(
            f"select '{c}' as table_name, k as missing_key, count(*) as refs from (select distinct {r} as r, {_KEY.format(c=ref)} as k from {c} where {live}) where k is not null "
            f"and k not in (select {_KEY.format(c=k)} from {p} where deleted_at is null and {_KEY.format(c=k)} is not null) group by k"
        )
    return " union all ".join(parts)


ORACLES = {
    "p2_found": f"select distinct table_name, row_key from ({_found_sql()})",
    "p2_monthly": f"select table_name, strftime(moment at time zone 'UTC', '%Y-%m') as month, count(distinct row_key) as orphans from ({_found_sql()}) group by all",
    "p2_current": _current_sql(),
    "p2_maintained": _current_sql(),
}
