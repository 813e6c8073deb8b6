"""The run store: runs, tasks, events and evidence as append-only tables whose current state is a view.

Nothing is updated in place. A retry or a change of status is a further version of the row, and the latest version
wins; an insert that must not repeat is an anti join before the append.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import norm_key, table
from .relational import first_per_key


def current(versions: DataFrame, key: list[str]) -> DataFrame:
    """The latest version of each key by arrival."""
    return first_per_key(versions, key, [F.desc("loaded_at"), F.desc_nulls_last("status")])


def new_rows(incoming: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows whose key is not there yet: insert or ignore."""
    return incoming.join(existing.select(*key), key, "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], stamp: str) -> DataFrame:
    """Both sides' rows, of each key the one with the later stamp, incoming first of equals."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return first_per_key(both, key, [F.desc(stamp), F.desc("_new")]).drop("_new")


#: The five tables of a run store. The first column is the key; the column behind the bar, if any, partitions the files.
TABLES = {
    "runs": "run_id string, label string, status string, started_at timestamp, ended_at timestamp, git_commit string, config string, notes string, loaded_at timestamp",
    "tasks": "task_id string, run_id string, parent_id string, key string, kind string, status string, started_at timestamp, ended_at timestamp, error string, input string, output string, loaded_at timestamp | run_id",
    "events": "event_id bigint, run_id string, task_id string, ts timestamp, kind string, name string, payload string, duration_ms bigint | run_id",
    "evidence": "evidence_id bigint, run_id string, task_id string, ticker string, metric string, claim string, value double, units string, source string, ts timestamp | run_id",
    "profiles": "ticker string, horizon string, body string, saved_at timestamp, deleted boolean",
}


def create_tables(spark: SparkSession, folder: str) -> None:
    """Empty tables of the run store where there are none yet; what stands there stays."""
    for name, text in TABLES.items():
        columns, _, by = (x.strip() for x in text.partition("|"))
        spark.createDataFrame([], columns).write.mode("ignore").partitionBy(*[by] if by else []).parquet(f"{folder.rstrip('/')}/{name}")


def migrated(rows: DataFrame, columns: str) -> DataFrame:
    """rows with the columns they lack as nulls; further columns of theirs stay. Old and new files are read as one by this."""
    have = {c.lower() for c in rows.columns}
    wanted = StructType.fromDDL(columns)
    return rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in wanted if f.name.lower() not in have])


def delete(existing: DataFrame, keys: DataFrame, key: list[str], stamp: str, now: Column) -> DataFrame:
    """Rows to append that withdraw the present rows of some keys: upsert() then shows them as deleted."""
    present = first_per_key(existing, key, [F.desc(stamp)]).where("not coalesce(deleted, false)")
    return present.join(keys.select(*key).distinct(), key, "left_semi").withColumn("deleted", F.lit(True)).withColumn(stamp, now).select(existing.columns)


def completed(tasks: DataFrame) -> DataFrame:
    return current(tasks, ["task_id"]).where("status = 'completed'")


def seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def _events(spark, sf_dir):
    return table(spark, sf_dir, "run_events").dropDuplicates(["event_id"])


def q2_insert_or_ignore(spark, sf_dir):
    """Runs of which only a later version has a status other than the first one's: rows an insert would ignore."""
    r = table(spark, sf_dir, "runs").select(norm_key("run_id").alias("run_id"), "started_at", "loaded_at", "status")
    early = r.where("loaded_at < timestamp '2025-06-01 00:00:00'").select("run_id").distinct()
    return new_rows(r.where("loaded_at >= timestamp '2025-06-01 00:00:00'").select("run_id").distinct(), early, ["run_id"])


def q3_current_tasks(spark, sf_dir):
    return current(table(spark, sf_dir, "tasks"), ["task_id"]).select("task_id", "status", "ended_at")


def q4_latest_runs(spark, sf_dir):
    return current(table(spark, sf_dir, "runs"), ["run_id"]).select("run_id", "status", "loaded_at")


def q5_completed_keys(spark, sf_dir):
    return completed(table(spark, sf_dir, "tasks")).select("task_id", "key").distinct()


def q7_evidence(spark, sf_dir):
    """The evidence of one ticker's metric, most confident first."""
    e = table(spark, sf_dir, "evidence").dropDuplicates(["evidence_id"])
    tk = F.upper(F.element_at(F.split("ticker", ":"), -1))
    return e.where((tk == "WEXW") & (F.col("metric") == "Net income")).select("evidence_id", "confidence", "value")


def q8_latest_wins(spark, sf_dir):
    """Profiles by ticker and metric: the anchor captured last."""
    g = table(spark, sf_dir, "guidance_anchors").select("ticker", "metric", "anchor_id", "captured_at", "value").distinct()
    old, new = g.where("anchor_id % 2 = 0"), g.where("anchor_id % 2 = 1")
    one = lambda d: first_per_key(d, ["ticker", "metric"], [F.desc("captured_at"), F.desc("anchor_id")])
    return upsert(one(old), one(new), ["ticker", "metric"], "captured_at").select("ticker", "metric", "anchor_id", "value")


def b3_sequence(spark, sf_dir):
    """A gapless number of each run's events in order of time."""
    k = F.row_number().over(Window.partitionBy("run_id").orderBy("ts", "event_id"))
    return _events(spark, sf_dir).select("event_id", "run_id", k.alias("seq"))


def b4_stage_times(spark, sf_dir):
    """Per run and kind of event: first and last moment and the seconds between."""
    g = _events(spark, sf_dir).groupBy("run_id", "kind").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    return g.select("run_id", "kind", "n", F.round(seconds(F.col("a"), F.col("b")), 3).alias("seconds"))


def b8_log_export(spark, sf_dir):
    """Events with their task's key and agent, each as one line of text."""
    t = current(table(spark, sf_dir, "tasks"), ["task_id"]).select(norm_key("task_id").alias("tk"), "key", "agent_name")
    e = _events(spark, sf_dir).withColumn("tk", norm_key("task_id"))
    j = e.join(t, "tk", "left")
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.coalesce("agent_name", F.lit("-")), F.coalesce("key", F.lit("-")), F.coalesce("kind", F.lit("-")), F.coalesce("name", F.lit("-")))
    return j.select("event_id", line.alias("line"))


def g13_run_summary(spark, sf_dir):
    """Per run: tasks by status, events and evidence."""
    t = current(table(spark, sf_dir, "tasks"), ["task_id"]).select(norm_key("run_id").alias("run_id"), "status").where("run_id is not null")
    tasks = t.groupBy("run_id").agg(F.count("*").alias("tasks"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))
    ev = _events(spark, sf_dir).groupBy(norm_key("run_id").alias("run_id")).agg(F.count("*").alias("events"))
    ee = table(spark, sf_dir, "evidence").dropDuplicates(["evidence_id"]).groupBy(norm_key("run_id").alias("run_id")).agg(F.count("*").alias("evidence"))
    j = tasks.join(ev, "run_id", "left").join(ee, "run_id", "left")
    return j.select("run_id", "tasks", "completed", "failed", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("evidence", F.lit(0)).alias("evidence"))


def g14_newest_run(spark, sf_dir):
    r = table(spark, sf_dir, "runs").agg(F.max(F.struct("started_at", "run_id")).alias("s"))
    return r.select("s.run_id", "s.started_at")


def g15_durations(spark, sf_dir):
    t = current(table(spark, sf_dir, "tasks"), ["task_id"]).where("ended_at is not null")
    return t.groupBy("kind").agg(F.count("*").alias("tasks"), F.round(F.sum(F.unix_millis("ended_at") - F.unix_millis("started_at")) / 1000.0, 3).alias("seconds"))


def g17_tool_calls(spark, sf_dir):
    return _events(spark, sf_dir).where("kind = 'tool_call'").groupBy("name").agg(F.count("*").alias("calls"))


QUERIES = {f.__name__: f for f in (q2_insert_or_ignore, q3_current_tasks, q4_latest_runs, q5_completed_keys, q7_evidence, q8_latest_wins, b3_sequence, b4_stage_times, b8_log_export, g13_run_summary, g14_newest_run, g15_durations, g17_tool_calls)}
_SP = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160)"
_N = "nullif(lower(trim({c}, " + _SP + ")), '')"
_CUR = "cur as (select * from (select *, row_number() over (partition by task_id order by loaded_at desc, status desc nulls last) as k from tasks) where k = 1)"
_EV = "ev as (select distinct on (event_id) * from run_events)"
ORACLES = {
    "q2_insert_or_ignore": f"select distinct {_N.format(c='run_id')} as run_id from runs where loaded_at >= timestamptz '2025-06-01 00:00:00+00' and {_N.format(c='run_id')} not in (select {_N.format(c='run_id')} from runs where loaded_at < timestamptz '2025-06-01 00:00:00+00')",
    "q3_current_tasks": f"with {_CUR} select task_id, status, ended_at from cur",
    "q4_latest_runs": "select run_id, status, loaded_at from (select *, row_number() over (partition by run_id order by loaded_at desc, status desc nulls last) as k from runs) where k = 1",
    "q5_completed_keys": f"with {_CUR} select distinct task_id, key from cur where status = 'completed'",
    "q7_evidence": "select distinct evidence_id, confidence, value from evidence where upper(split_part(ticker, ':', -1)) = 'WEXW' and metric = 'Net income'",
    "q8_latest_wins": "with g as (select distinct ticker, metric, anchor_id, captured_at, value from guidance_anchors), r as (select *, row_number() over (partition by ticker, metric, anchor_id % 2 order by captured_at desc, anchor_id desc) as k from g), s as (select *, row_number() over (partition by ticker, metric order by captured_at desc, anchor_id % 2 desc) as j from r where k = 1) select ticker, metric, anchor_id, value from s where j = 1",
    "b3_sequence": f"with {_EV} select event_id, run_id, cast(row_number() over (partition by run_id order by ts, event_id) as integer) as seq from ev",
    "b4_stage_times": f"with {_EV} select run_id, kind, count(*) as n, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) as seconds from ev group by 1, 2",
    "b8_log_export": f"with {_CUR}, {_EV} select event_id, concat_ws(' ', strftime(ev.ts at time zone 'UTC', '%Y-%m-%d %H:%M:%S'), coalesce(agent_name, '-'), coalesce(key, '-'), coalesce(ev.kind, '-'), coalesce(name, '-')) as line from ev left join cur on {_N.format(c='ev.task_id')} = {_N.format(c='cur.task_id')}",
    "g13_run_summary": f"with {_CUR}, {_EV}, t as (select {_N.format(c='run_id')} as run_id, count(*) as tasks, count(*) filter (status = 'completed') as completed, count(*) filter (status = 'failed') as failed from cur group by 1), e as (select {_N.format(c='run_id')} as run_id, count(*) as events from ev group by 1), v as (select {_N.format(c='run_id')} as run_id, count(distinct evidence_id) as evidence from evidence group by 1) select t.run_id, tasks, completed, failed, coalesce(events, 0) as events, coalesce(evidence, 0) as evidence from t left join e using (run_id) left join v using (run_id) where t.run_id is not null",
    "g14_newest_run": "select run_id, started_at from (select distinct run_id, started_at from runs) order by started_at desc, run_id desc limit 1",
    "g15_durations": f"with {_CUR} select kind, count(*) as tasks, round(sum(epoch_ms(ended_at) - epoch_ms(started_at)) / 1000.0, 3) as seconds from cur where ended_at is not null group by 1",
    "g17_tool_calls": f"with {_EV} select name, count(*) as calls from ev where kind = 'tool_call' group by 1",
}
