"""Streams over the run log, and the same results over tables.

Each function takes a streaming or a batch DataFrame: windows count records, starts and ends of stages are paired, and
what is later than a cutoff allows is split off. The batch form is what the queries register.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import table

LATE = "10 minutes"


def tumbling(records: DataFrame, width: str = "1 hour", late: str = LATE) -> DataFrame:
    """(start, kind, n): records per window of event time and kind."""
    d = records.withWatermark("ts", late) if records.isStreaming else records
    return d.groupBy(F.window("ts", width), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "kind", "n")


def sessions(records: DataFrame, key: str, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """(key, start, end, n): runs of records of a key without a pause of `gap`. An extension."""
    d = records.withWatermark("ts", late) if records.isStreaming else records
    g = d.groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def stage_pairs(starts: DataFrame, ends: DataFrame, most: str = "2 hours", late: str = LATE) -> DataFrame:
    """(run_id, stage, started, ended): the ends that follow a start of the same run and stage within `most`."""
    s = starts.select(F.col("run_id").alias("sr"), F.col("stage").alias("ss"), F.col("ts").alias("started"))
    e = ends.select("run_id", "stage", F.col("ts").alias("ended"))
    if s.isStreaming:
        s, e = s.withWatermark("started", late), e.withWatermark("ended", late)
    cond = (F.col("sr") == F.col("run_id")) & (F.col("ss") == F.col("stage")) & (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"interval {most}"))
    return s.join(e, cond).select("run_id", "stage", "started", "ended")


def once(records: DataFrame, key: list[str], late: str = "1 day") -> DataFrame:
    """Records once per key: an idempotent resume, the state bounded by the watermark."""
    if records.isStreaming:
        return records.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)
    return records.dropDuplicates(key)


def split_by_cutoff(records: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """What a cutoff allows, and what it blocks; both keep streaming."""
    ok = F.coalesce(F.to_date("ts") <= F.lit(as_of), F.lit(False))
    return records.where(ok), records.where(~ok)


def open_tasks(records: DataFrame) -> DataFrame:
    """(task_id, open, last): per task how many starts have no end yet, kept as state across batches."""
    schema, state = "task_id string, open long, last timestamp", "open long, last timestamp"

    def step(key: tuple, batches: Iterator[pd.DataFrame], st) -> Iterator[pd.DataFrame]:
        n, last = st.get if st.exists else (0, None)
        for b in batches:
            n += int((b["kind"] == "start").sum()) - int((b["kind"] == "end").sum())
            top = b["ts"].max()
            last = top if last is None or top > last else last
        st.update((n, last))
        yield pd.DataFrame({"task_id": [key[0]], "open": [n], "last": [last]})

    return records.groupBy("task_id").applyInPandasWithState(step, schema, state, "update", "NoTimeout")


def ingest_documents(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """New Markdown files of a folder appended to a table as they arrive, each once; stops when all present ones are in."""
    from ..functions import text as T

    stream = spark.readStream.format("text").schema("value string").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    keys, body = T.front_matter(F.col("value"), ("company", "published_at", "document_type"))
    rows = stream.select(F.col("_metadata.file_path").alias("path"), *[v.alias(k) for k, v in keys.items()], body.alias("text"))
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_postings(spark: SparkSession, folder: str, index: str, checkpoint: str):
    """Postings and lengths of new Markdown files, added to an index as the files arrive; stops when all present ones are in.

    A batch is a sub-folder of its own, so one that is tried again replaces itself. Read <index>/postings and
    <index>/lengths as tables with search_postings().
    """
    from ..functions import text as T
    from ..operators.search import line_passages, postings

    stream = spark.readStream.format("text").schema("value string").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    keys, body = T.front_matter(F.col("value"), ("published_at",))
    docs = stream.select(F.col("_metadata.file_path").alias("doc_id"), keys["published_at"].try_cast("date").alias("published_at"), body.alias("text"))

    def add(batch: DataFrame, batch_id: int) -> None:
        for name, part in zip(("postings", "lengths"), postings(line_passages(batch)), strict=True):
            part.write.mode("overwrite").parquet(f"{index.rstrip('/')}/{name}/batch={batch_id}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _records(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("run_id"), F.col("event_type").alias("kind"), "ts")


def n1_tumbling(spark, sf_dir):
    return tumbling(_records(spark, sf_dir))


def n2_stage_pairs(spark, sf_dir):
    """A view begins and a purchase ends a stage of the same user, within two hours."""
    r = _records(spark, sf_dir).withColumn("stage", F.lit("buy"))
    p = stage_pairs(r.where("kind = 'view'"), r.where("kind = 'purchase'"))
    return p.select("run_id", "started", "ended")


def n3_late_split(spark, sf_dir):
    from datetime import date

    ok, late = split_by_cutoff(_records(spark, sf_dir), date(2024, 1, 20))
    tag = lambda d, t: d.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(t).alias("part"), "kind", "n")
    return tag(ok, "allowed").unionByName(tag(late, "blocked"))


def n4_sessions(spark, sf_dir):
    return sessions(_records(spark, sf_dir), "run_id", "6 hours")


def n5_once(spark, sf_dir):
    """Run events once per id, as an idempotent sink keeps them."""
    return once(table(spark, sf_dir, "run_events").select("event_id", "kind", "ts"), ["event_id"]).groupBy("kind").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (n1_tumbling, n2_stage_pairs, n3_late_split, n4_sessions, n5_once)}
ORACLES = {
    "n1_tumbling": "select date_trunc('hour', ts) as start, event_type as kind, count(*) as n from events group by 1, 2",
    "n2_stage_pairs": "select a.user_id as run_id, a.ts as started, b.ts as ended from events a join events b on a.user_id = b.user_id and a.event_type = 'view' and b.event_type = 'purchase' and b.ts >= a.ts and b.ts <= a.ts + interval 2 hour",
    "n3_late_split": "select case when cast(ts as date) <= date '2024-01-20' then 'allowed' else 'blocked' end as part, event_type as kind, count(*) as n from events group by 1, 2",
    "n4_sessions": "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts) as s from g) select user_id as run_id, min(ts) as start, max(ts) + interval 6 hour as \"end\", count(*) as n from s group by user_id, s",
    "n5_once": "select kind, count(distinct event_id) as n from run_events group by 1",
}
