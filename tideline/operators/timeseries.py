"""Irregular time series: nearest and as-of joins, growth, trend, seasonality, guidance bias, price statistics.

A series is a table of (series key, day, value); points of many series and of both kinds go through one plan, never
through a loop over series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

QUARTER_DAYS, CYCLE_TOLERANCE, YEAR_TOLERANCE = 91, 45, 60
#: Trend windows and their days (fixed values).
WINDOWS = (("6m", 182), ("2y", 730), ("5y", 1826), ("10y", 3652))


def quarterly_totals(spark, sf_dir) -> DataFrame:
    """(key, day, value): order totals per market segment and quarter, dated at the quarter's last day."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("key"))
    day = F.date_sub(F.add_months(F.trunc(F.col("o_orderdate").cast("date"), "quarter"), 3), 1)
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return o.join(c, "o_custkey").groupBy("key", day.alias("day")).agg((F.sum(cents) / 100.0).alias("value"))


def guided_totals(points: DataFrame) -> DataFrame:
    """A guided value per quarter: the mean of it and the one before, as if said for the next."""
    by = Window.partitionBy("key").orderBy("day")
    return points.select("key", "day", ((F.col("value") + F.lag("value").over(by)) / 2).alias("value")).where("value is not null")


def nearest(left: DataFrame, points: DataFrame, key: str, target: Column, tolerance: int, keep: list[str]) -> DataFrame:
    """left with `near` = struct(gap, day, value): the point of the same key nearest in time to target, within tolerance days.

    The older of equals wins; rows without such a point have null.
    """
    l = left.withColumn("_t", target)  # noqa: E741
    p = points.select(F.col(key).alias("_k"), F.col("day").alias("_d"), F.col("value").alias("_v"))
    gap = F.abs(F.date_diff(F.col("_d"), F.col("_t")))
    cond = (F.col(key) == F.col("_k")) & F.col("_d").between(F.date_sub("_t", tolerance), F.date_add("_t", tolerance))
    hit = F.when(F.col("_d").isNotNull(), F.struct(gap.alias("gap"), F.col("_d").alias("day"), F.col("_v").alias("value")))
    return l.join(p, cond, "left").groupBy(*keep).agg(F.min(hit).alias("near"))


def latest(points: DataFrame, key: str = "key") -> DataFrame:
    return points.groupBy(key).agg(F.max(F.struct("day", "value")).alias("s")).select(key, "s.day", "s.value")


def growth(now: Column, before: Column) -> Column:
    """Relative change; null where the base is next to zero."""
    return F.when(F.abs(before) >= 1e-9, (now - before) / F.abs(before))


def year_ago(points: DataFrame) -> DataFrame:
    """(key, day, value, prior_day, prior, growth) for each series' latest point."""
    n = nearest(latest(points), points, "key", F.date_sub("day", 365), YEAR_TOLERANCE, ["key", "day", "value"])
    return n.select("key", "day", "value", F.col("near.day").alias("prior_day"), F.col("near.value").alias("prior"), growth(F.col("value"), F.col("near.value")).alias("growth"))


def bias(points: DataFrame, guided: DataFrame, least: int = 3) -> DataFrame:
    """How results compare with what was guided a cycle before, per series with at least `least` pairs."""
    n = nearest(guided, points, "key", F.date_add("day", QUARTER_DAYS), CYCLE_TOLERANCE, ["key", "day", "value"])
    s = n.where("near is not null and abs(value) >= 1e-9").select("key", F.round(growth(F.col("near.value"), F.col("value")), 6).alias("s"))
    g = s.groupBy("key").agg(F.count("*").alias("n"), F.median("s").alias("median"), F.avg("s").alias("mean"), F.stddev_samp("s").alias("sd"), F.avg((F.col("s") > 0).cast("int")).alias("beat"))
    return g.where(F.col("n") >= least).select("key", F.col("n").alias("observations"), F.round("median", 6).alias("median_surprise"), F.round("mean", 6).alias("mean_surprise"), F.when(F.col("n") > 2, F.round("sd", 6)).alias("stdev_surprise"), F.round("beat", 4).alias("beat_rate"))


def trends(points: DataFrame) -> DataFrame:
    """One row per series and window with at least two points in it."""
    spark = points.sparkSession
    w = spark.createDataFrame(list(WINDOWS), "window string, days int")  # four rows
    last = points.groupBy("key").agg(F.max("day").alias("last"))
    p = points.join(last, "key").join(F.broadcast(w)).where(F.col("day") >= F.expr("date_sub(last, days)"))
    g = p.groupBy("key", "window").agg(F.count("*").alias("n"), F.min(F.struct("day", "value")).alias("a"), F.max(F.struct("day", "value")).alias("b"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).where("n >= 2")
    span = F.greatest(F.date_diff(F.col("b.day"), F.col("a.day")) / 365.25, F.lit(1e-6))
    up = (F.col("a.value") > 0) & (F.col("b.value") > 0)
    return g.select(
        "key", "window", F.col("n").alias("observations"), F.round(span, 2).alias("span_years"), F.round("mean", 4).alias("mean"), F.when(F.col("n") > 2, F.round("sd", 4)).alias("stdev"),
        F.when(up, F.round(F.pow(F.col("b.value") / F.col("a.value"), 1 / span) - 1, 6)).alias("cagr"), F.when(~up, F.round((F.col("b.value") - F.col("a.value")) / span, 6)).alias("change_per_year"))


def moving_mean(points: DataFrame, each_side: int = 2) -> DataFrame:
    by = Window.partitionBy("key").orderBy("day").rowsBetween(-each_side, each_side)
    return points.withColumn("mean", F.avg("value").over(by))


def seasonality(points: DataFrame, least: int = 8) -> DataFrame:
    """(key, month, index): the mean ratio of a month's values to the centred mean, for months with two or more and series with two such months."""
    by = Window.partitionBy("key")
    m = moving_mean(points).withColumn("_n", F.count("*").over(by)).where(F.col("_n") >= least)
    r = m.where(F.abs("mean") >= 1e-9).groupBy("key", F.month("day").alias("month")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("value") / F.col("mean")), 4).alias("index"))
    return r.where("n >= 2").withColumn("_m", F.count("*").over(by)).where("_m >= 2").select("key", "month", "index")


def cyclical(points: DataFrame) -> DataFrame:
    """The last two growth rates, their direction in words, the mean growth and the naive projection."""
    by = Window.partitionBy("key").orderBy("day")
    g = points.withColumn("g", F.when(F.lag("value").over(by) != 0, growth(F.col("value"), F.lag("value").over(by)))).where("g is not null")
    s = g.groupBy("key").agg(F.max(F.struct("day", "value", "g")).alias("b"), F.sort_array(F.collect_list(F.struct("day", "g")), False).alias("all"), F.avg("g").alias("mean"))
    now, before = F.col("b.g"), F.get("all", F.lit(1))["g"]
    word = (
        F.when(before.isNull(), "single interval")
        .when((now >= 0) & (before >= 0), F.when(now > before, "growth accelerating").otherwise("growth slowing"))
        .when((now < 0) & (before < 0), F.when(now > before, "decline easing").otherwise("decline deepening"))
        .when(now >= 0, "inflected positive").otherwise("inflected negative")
    )
    return s.select("key", F.round(now, 4).alias("recent_growth"), F.round("mean", 4).alias("mean_growth"), word.alias("direction"), F.round(F.col("b.value") * (1 + now), 4).alias("projection"))


def price_statistics(bars: DataFrame, spans: tuple[int, ...] = (1, 5, 21)) -> DataFrame:
    """Per key: trailing returns over numbers of bars, annual volatility of bar returns in percent, high and low.

    A span longer than the history by at most a tenth of itself reaches back to the oldest bar.
    """
    by = Window.partitionBy("key").orderBy("day")
    b = bars.withColumn("r", growth(F.col("value"), F.lag("value").over(by)))
    for n in spans:
        b = b.withColumn(f"_p{n}", F.lag("value", n).over(by))
    g = b.groupBy("key").agg(F.max(F.struct("day", "value", *[f"_p{n}" for n in spans])).alias("b"), F.min(F.struct("day", "value")).alias("a"), F.count("*").alias("n"), F.stddev_samp("r").alias("sd"), F.max("value").alias("high"), F.min("value").alias("low"))
    ret = [F.round(growth(F.col("b.value"), F.coalesce(F.col(f"b._p{n}"), F.when(F.col("n") - 1 >= n * 0.9, F.col("a.value")))) * 100, 4).alias(f"return_{n}") for n in spans]
    return g.select("key", "n", *ret, F.round(F.col("sd") * F.sqrt(F.lit(252.0)) * 100, 4).alias("volatility"), "high", "low")


def _daily(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("key"), F.to_date("ts").alias("day")).agg((F.sum(F.round(F.col("value") * 10000).cast("long")) / 10000.0).alias("value"))


def fiscal_quarter(day: Column, end_month: int, offset: int = 0) -> Column:
    """Label FYyyyyQn of the quarter a report of this day is about, for a fiscal year that ends in end_month."""
    d = F.date_sub(day, 15)
    past = F.pmod(F.month(d) - 1 - end_month, F.lit(12))
    year = F.year(d) + F.when(F.month(d) > end_month, 1).otherwise(0) + offset
    return F.concat(F.lit("FY"), year, F.lit("Q"), F.floor(past / 3).cast("int") + 1)


def f5_nearest(spark, sf_dir):
    """Each customer order's nearest quarter end within 45 days, on the first 90 days of a segment's series."""
    p = quarterly_totals(spark, sf_dir)
    left = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("key")).agg(F.count("*").alias("n"))
    left = left.withColumn("day", F.explode(F.sequence(F.lit("1995-01-15").cast("date"), F.lit("2001-06-15").cast("date"), F.expr("interval 1 month"))))
    return nearest(left, p, "key", F.col("day"), CYCLE_TOLERANCE, ["key", "day"]).select("key", "day", F.col("near.day").alias("near_day"), F.col("near.gap").alias("gap"), F.col("near.value").alias("value"))


def f6_asof_documents(spark, sf_dir):
    """For each company and month start, the newest document published by then."""
    d = table(spark, sf_dir, "documents").where("published_at is not null and company_slug is not null")
    months = d.select("company_slug").distinct().withColumn("day", F.explode(F.sequence(F.lit("2023-01-01").cast("date"), F.lit("2026-06-01").cast("date"), F.expr("interval 1 month"))))
    best = F.max(F.struct("published_at", "doc_id"))
    # per company and month first, then a running best: no document meets every month
    month = F.add_months(F.trunc(F.date_sub("published_at", 1), "month"), 1)
    per = d.groupBy("company_slug", month.alias("day")).agg(best.alias("s"))
    both = months.join(per, ["company_slug", "day"], "full")
    run = F.max("s").over(Window.partitionBy("company_slug").orderBy("day"))
    return both.withColumn("b", run).join(months, ["company_slug", "day"], "left_semi").select("company_slug", "day", F.col("b.published_at").alias("published_at"), F.col("b.doc_id").alias("doc_id"))


def f7_guidance_pairs(spark, sf_dir):
    p = quarterly_totals(spark, sf_dir)
    n = nearest(guided_totals(p), p, "key", F.date_add("day", QUARTER_DAYS), CYCLE_TOLERANCE, ["key", "day", "value"])
    return n.where("near is not null").select("key", F.col("day").alias("guided_on"), F.col("value").alias("guided"), F.col("near.day").alias("reported_on"), F.col("near.value").alias("reported"))


def f8_year_ago(spark, sf_dir):
    return year_ago(quarterly_totals(spark, sf_dir)).select("key", "day", "value", "prior_day", "prior", F.round("growth", 8).alias("growth"))


def g5_bias(spark, sf_dir):
    p = quarterly_totals(spark, sf_dir)
    return bias(p, guided_totals(p))


def g6_trend(spark, sf_dir):
    return trends(quarterly_totals(spark, sf_dir))


def g7_seasonality(spark, sf_dir):
    return seasonality(quarterly_totals(spark, sf_dir))


def g10_cyclical(spark, sf_dir):
    return cyclical(quarterly_totals(spark, sf_dir))


def g18_prices(spark, sf_dir):
    return price_statistics(_daily(spark, sf_dir))


def h2_moving_mean(spark, sf_dir):
    return moving_mean(quarterly_totals(spark, sf_dir)).select("key", "day", F.round("mean", 4).alias("mean"))


def h3_growth(spark, sf_dir):
    by = Window.partitionBy("key").orderBy("day")
    return quarterly_totals(spark, sf_dir).select("key", "day", F.round(growth(F.col("value"), F.lag("value").over(by)), 8).alias("growth"))


def h4_first_last(spark, sf_dir):
    return quarterly_totals(spark, sf_dir).groupBy("key").agg(F.min_by("value", "day").alias("first"), F.max_by("value", "day").alias("last"), F.max("value").alias("most"))


def h9_tail(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("day")))
    return quarterly_totals(spark, sf_dir).withColumn("k", k).where("k <= 8").select("key", "day", "value")


def k_period_labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("published_at is not null")
    return d.select("doc_id", fiscal_quarter(F.col("published_at"), 1, -1).alias("jan"), fiscal_quarter(F.col("published_at"), 10).alias("oct"), fiscal_quarter(F.col("published_at"), 12).alias("dec"))


QUERIES = {f.__name__: f for f in (f5_nearest, f6_asof_documents, f7_guidance_pairs, f8_year_ago, g5_bias, g6_trend, g7_seasonality, g10_cyclical, g18_prices, h2_moving_mean, h3_growth, h4_first_last, h9_tail, k_period_labels)}

SERIES_SQL = "p as (select c_mktsegment as key, cast(date_trunc('quarter', o_orderdate) + interval 3 month - interval 1 day as date) as day, sum(cast(round(o_totalprice * 100) as bigint)) / 100.0 as value from orders join customer on o_custkey = c_custkey group by 1, 2)"
_G = "g as (select * from (select key, day, (value + lag(value) over (partition by key order by day)) / 2 as value from p) where value is not null)"
_PAIRS = _G + ", x as (select g.key, g.day as guided_on, g.value as guided, p.day as reported_on, p.value as reported, row_number() over (partition by g.key, g.day order by abs(p.day - (g.day + 91)), p.day) as k from g join p on g.key = p.key and p.day between g.day + 91 - 45 and g.day + 91 + 45), pairs as (select * from x where k = 1)"
_FQ = "concat('FY', year(published_at - 15) + (case when month(published_at - 15) > {m} then 1 else 0 end) + {o}, 'Q', cast(floor(((month(published_at - 15) - 1 - {m} + 24) % 12) / 3) as integer) + 1)"
ORACLES = {
    "f5_nearest": f"with {SERIES_SQL}, s as (select distinct c_mktsegment as key from customer), l as (select key, cast(unnest(generate_series(date '1995-01-15', date '2001-06-15', interval 1 month)) as date) as day from s), j as (select l.key, l.day, p.day as near_day, abs(p.day - l.day) as gap, p.value, row_number() over (partition by l.key, l.day order by abs(p.day - l.day), p.day) as k from l left join p on l.key = p.key and p.day between l.day - 45 and l.day + 45) select key, day, near_day, cast(gap as integer) as gap, value from j where k = 1",
    "f6_asof_documents": "with d as (select * from documents where published_at is not null and company_slug is not null), m as (select distinct company_slug from d), l as (select company_slug, cast(unnest(generate_series(date '2023-01-01', date '2026-06-01', interval 1 month)) as date) as day from m), j as (select l.company_slug, l.day, d.published_at, d.doc_id, row_number() over (partition by l.company_slug, l.day order by d.published_at desc nulls last, d.doc_id desc) as k from l left join d on d.company_slug = l.company_slug and d.published_at <= l.day) select company_slug, day, published_at, doc_id from j where k = 1",
    "f7_guidance_pairs": f"with {SERIES_SQL}, {_PAIRS} select key, guided_on, guided, reported_on, reported from pairs",
    "f8_year_ago": f"with {SERIES_SQL}, l as (select key, max(day) as day, max_by(value, day) as value from p group by 1), j as (select l.*, p.day as prior_day, p.value as prior, row_number() over (partition by l.key order by abs(p.day - (l.day - 365)), p.day) as k from l left join p on l.key = p.key and p.day between l.day - 425 and l.day - 305) select key, day, value, prior_day, prior, round((value - prior) / abs(prior), 8) as growth from j where k = 1",
    "g5_bias": f"with {SERIES_SQL}, {_PAIRS}, s as (select key, round((reported - guided) / abs(guided), 6) as s from pairs) select key, count(*) as observations, round(median(s), 6) as median_surprise, round(avg(s), 6) as mean_surprise, round(stddev_samp(s), 6) as stdev_surprise, round(avg(case when s > 0 then 1 else 0 end), 4) as beat_rate from s group by key having count(*) >= 3",
    "g6_trend": f"with {SERIES_SQL}, w as (select * from (values ('6m', 182), ('2y', 730), ('5y', 1826), ('10y', 3652)) t(win, days)), l as (select key, max(day) as last from p group by 1), q as (select p.*, win from p join l using (key), w where day >= last - days), a as (select key, win, count(*) as n, min(day) as d0, max(day) as d1, min_by(value, day) as v0, max_by(value, day) as v1, avg(value) as mean, stddev_samp(value) as sd from q group by 1, 2 having count(*) >= 2) select key, win as \"window\", n as observations, round((d1 - d0) / 365.25, 2) as span_years, round(mean, 4) as mean, case when n > 2 then round(sd, 4) end as stdev, case when v0 > 0 and v1 > 0 then round(pow(v1 / v0, 365.25 / (d1 - d0)) - 1, 6) end as cagr, case when not (v0 > 0 and v1 > 0) then round((v1 - v0) / ((d1 - d0) / 365.25), 6) end as change_per_year from a",
    "g7_seasonality": f"with {SERIES_SQL}, m as (select *, avg(value) over (partition by key order by day rows between 2 preceding and 2 following) as mean, count(*) over (partition by key) as n from p), r as (select key, cast(month(day) as integer) as month, count(*) as c, round(avg(value / mean), 4) as index from m where n >= 8 and abs(mean) >= 1e-9 group by 1, 2 having count(*) >= 2) select key, month, index from (select *, count(*) over (partition by key) as k from r) where k >= 2",
    "g10_cyclical": f"with {SERIES_SQL}, q as (select key, day, value, (value - lag(value) over (partition by key order by day)) / abs(lag(value) over (partition by key order by day)) as g from p), r as (select *, row_number() over (partition by key order by day desc) as k from q where g is not null), s as (select key, max(case when k = 1 then g end) as a, max(case when k = 2 then g end) as b, max(case when k = 1 then value end) as v, avg(g) as mean from r group by 1) select key, round(a, 4) as recent_growth, round(mean, 4) as mean_growth, case when b is null then 'single interval' when a >= 0 and b >= 0 then case when a > b then 'growth accelerating' else 'growth slowing' end when a < 0 and b < 0 then case when a > b then 'decline easing' else 'decline deepening' end when a >= 0 then 'inflected positive' else 'inflected negative' end as direction, round(v * (1 + a), 4) as projection from s",
    "g18_prices": "with b as (select event_type as key, cast(ts as date) as day, sum(cast(round(value * 10000) as bigint)) / 10000.0 as value from events group by 1, 2), r as (select *, row_number() over (partition by key order by day desc) as k, count(*) over (partition by key) as n, (value - lag(value) over (partition by key order by day)) / abs(lag(value) over (partition by key order by day)) as r from b) select key, count(*) as n, round((max(case when k = 1 then value end) / max(case when k = 2 then value end) - 1) * 100, 4) as return_1, round((max(case when k = 1 then value end) / coalesce(max(case when k = 6 then value end), case when max(n) - 1 >= 4.5 then max(case when k = n then value end) end) - 1) * 100, 4) as return_5, round((max(case when k = 1 then value end) / coalesce(max(case when k = 22 then value end), case when max(n) - 1 >= 18.9 then max(case when k = n then value end) end) - 1) * 100, 4) as return_21, round(stddev_samp(r) * sqrt(252.0) * 100, 4) as volatility, max(value) as high, min(value) as low from r group by key",
    "h2_moving_mean": f"with {SERIES_SQL} select key, day, round(avg(value) over (partition by key order by day rows between 2 preceding and 2 following), 4) as mean from p",
    "h3_growth": f"with {SERIES_SQL} select key, day, round((value - lag(value) over (partition by key order by day)) / abs(lag(value) over (partition by key order by day)), 8) as growth from p",
    "h4_first_last": f"with {SERIES_SQL} select key, min_by(value, day) as first, max_by(value, day) as last, max(value) as most from p group by 1",
    "h9_tail": f"with {SERIES_SQL}, r as (select *, row_number() over (partition by key order by day desc) as k from p) select key, day, value from r where k <= 8",
    "k_period_labels": f"select doc_id, {_FQ.format(m=1, o=-1)} as jan, {_FQ.format(m=10, o=0)} as oct, {_FQ.format(m=12, o=0)} as dec from documents where published_at is not null",
}
