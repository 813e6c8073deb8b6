"""Problem 5: attributes as known at event time.

Anchors are ordered by the moment they became available, the later of publication and capture. Per series and moment
only the best anchor matters (prior tie resolution), and the running best over availability gives the series' state
at any time. Events and states are hash-partitioned into buckets and each bucket runs one embedded ASOF LEFT JOIN.

A series is cut into spans of SPAN_DAYS, each opening with the state carried over from earlier spans, and the events
of a span into slots of at most about SLOT_ROWS, so that no bucket ever holds a whole hot series.

Defined results: events without series or ts, and anchors that were never published, captured or have no series, match
nothing; repeated anchors count once; ties go to the later publication, then the later capture, then the larger id.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import midnight, parse_moment
from .common import norm_key, table

SPAN_DAYS = 30
SLOT_ROWS = 200_000

_SQL = """
with v as (
  select g, avail, max(struct_pack(pub := pub, cap := cap, id := id)) over (partition by g order by avail) as best from states)
select e.event_id, v.best.id as anchor_id
from events e asof left join v on e.g = v.g and e.ts >= v.avail
where v.best.id is not null
"""


def _join_bucket(events: pa.Table, states: pa.Table) -> pa.Table:
    import duckdb

    out = pa.schema([("event_id", pa.int64()), ("anchor_id", pa.int64())])
    if not events.num_rows or not states.num_rows:
        return out.empty_table()
    con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
    try:
        con.register("events", events)
        con.register("states", states)
        return con.execute(_SQL).to_arrow_table().cast(out)
    finally:
        con.close()


def asof_best(events: DataFrame, anchors: DataFrame, span_days: int = SPAN_DAYS, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """(event_id, anchor_id) of every event that has a valid anchor.

    events: event_id bigint, series_id, ts. anchors: anchor_id bigint, series_id, pub, cap (timestamps).
    """
    span = lambda c: F.floor(F.unix_micros(c) / F.lit(span_days * 86_400_000_000))
    a = anchors.where("series_id is not null and anchor_id is not null and pub is not null and cap is not null")
    a = a.select("series_id", F.greatest("pub", "cap").alias("avail"), F.struct("pub", "cap", F.col("anchor_id").alias("id")).alias("s"))
    states = a.groupBy("series_id", "avail").agg(F.max("s").alias("s")).withColumn("span", span("avail"))
    e = events.where("series_id is not null and ts is not null and event_id is not null").select("event_id", "series_id", "ts").withColumn("span", span("ts"))

    # what each span with events opens with, and into how many slots its events go
    spans = (
        e.groupBy("series_id", "span").agg(F.count("*").alias("n"))
        .select("series_id", "span", "n", F.lit(None).cast(states.schema["s"].dataType).alias("s"))
        .unionByName(states.groupBy("series_id", "span").agg(F.max("s").alias("s")).select("series_id", "span", F.lit(0).cast("long").alias("n"), "s"))
        .groupBy("series_id", "span").agg(F.sum("n").alias("n"), F.max("s").alias("s"))
    )
    before = Window.partitionBy("series_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("carried", F.max("s").over(before)).withColumn("slots", F.ceil(F.col("n") / F.lit(slot_rows)).cast("int")).where("n > 0")
    slots = spans.select("series_id", "span", "slots", "carried")

    start = F.timestamp_micros(F.col("span") * F.lit(span_days * 86_400_000_000))
    opening = slots.where("carried is not null").select("series_id", "span", "slots", start.alias("avail"), F.col("carried").alias("s"))
    inside = states.join(slots.select("series_id", "span", "slots"), ["series_id", "span"]).select("series_id", "span", "slots", "avail", "s")
    versions = opening.unionByName(inside).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    split = slots.where("slots > 1").select("series_id", "span", "slots")
    ev = e.join(split, ["series_id", "span"], "left").withColumn("slot", F.when(F.col("slots").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("event_id"), F.col("slots")).cast("int")))

    buckets = max(16, -(-events.count() // slot_rows))
    group = F.xxhash64("series_id", "span", "slot")
    place = F.pmod(F.col("g"), F.lit(buckets)).cast("int").alias("bucket")
    ev = ev.withColumn("g", group).select(place, "g", "ts", "event_id")
    versions = versions.withColumn("g", group).select(place, "g", "avail", "s.pub", "s.cap", "s.id")
    return ev.groupBy("bucket").cogroup(versions.groupBy("bucket")).applyInArrow(_join_bucket, "event_id long, anchor_id long")


def anchors_with_dates(anchors: DataFrame, documents: DataFrame) -> DataFrame:
    """(anchor_id, series_id, pub, cap): publication from published_at or else from the document cited."""
    own = anchors.select("anchor_id", "series_id", parse_moment(F.col("published_at")).alias("own"), norm_key("published_at").isNotNull().alias("stated"), norm_key("source_path").alias("path"), F.col("captured_at").alias("cap"))
    docs = documents.select(norm_key("rel_path").alias("path"), midnight(F.col("published_at")).alias("doc_pub")).where("path is not null and doc_pub is not null")
    docs = docs.groupBy("path").agg(F.max("doc_pub").alias("doc_pub"))
    stated = own.where("stated").select("anchor_id", "series_id", F.col("own").alias("pub"), "cap")
    cited = own.where("not stated").join(docs, "path").select("anchor_id", "series_id", F.col("doc_pub").alias("pub"), "cap")
    return stated.unionByName(cited)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "evidence").select(F.col("evidence_id").alias("event_id"), "series_id", "ts")
    anchors = anchors_with_dates(table(spark, sf_dir, "guidance_anchors"), table(spark, sf_dir, "documents"))
    pairs = asof_best(ev, anchors)
    return pairs.select("anchor_id", F.col("event_id").alias("evidence_id")).distinct()


def p5_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every evidence row, once, with the value and units of the anchor valid and known at its ts, null where none is."""
    ev = table(spark, sf_dir, "evidence")
    known = p5_found(spark, sf_dir)
    a = table(spark, sf_dir, "guidance_anchors").groupBy("anchor_id").agg(F.min(F.struct("value", "units")).alias("a"))
    rows = ev.groupBy("evidence_id").agg(F.min(F.struct("series_id", "ts", "value")).alias("e"))
    return rows.join(known.join(a, "anchor_id"), "evidence_id", "left").select(
        "evidence_id", "e.series_id", "e.ts", F.col("e.value").alias("value"), "anchor_id", F.col("a.value").alias("anchor_value"), F.col("a.units").alias("anchor_units"))


QUERIES = {"p5_found": p5_found, "p5_joined": p5_joined}

_PAIRS = """
with d as (select lower(trim(rel_path)) as path, max(published_at) as pd from documents where published_at is not null group by 1),
a as (select distinct anchor_id, series_id, captured_at as cap, nullif(trim(published_at), '') as s, lower(trim(source_path)) as path from guidance_anchors),
p as (select anchor_id, series_id, cap,
  case when s is null then timezone('UTC', cast(d.pd as timestamp))
       when regexp_matches(s, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T') then try_cast(s as timestamptz)
       else timezone('UTC', coalesce(try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%Y%m%d'), try_strptime(s, '%Y/%m/%d'), try_strptime(s, '%d %B %Y'), try_strptime(s, '%d %b %Y'))) end as pub
  from a left join d using (path)),
e as (select distinct evidence_id, series_id, ts, value from evidence),
r as (select e.evidence_id, p.anchor_id, row_number() over (partition by e.evidence_id order by p.pub desc, p.cap desc, p.anchor_id desc) as n
      from e join p on e.series_id = p.series_id and p.pub <= e.ts and p.cap <= e.ts),
f as (select anchor_id, evidence_id from r where n = 1)
"""
ORACLES = {
    "p5_found": _PAIRS + "select anchor_id, evidence_id from f",
    "p5_joined": _PAIRS + ", v as (select distinct anchor_id, value as anchor_value, units as anchor_units from guidance_anchors) "
    "select e.evidence_id, e.series_id, e.ts, e.value, f.anchor_id, v.anchor_value, v.anchor_units from e left join f using (evidence_id) left join v using (anchor_id)",
}
