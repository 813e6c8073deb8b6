"""Validation: rules as columns, one row per check with a status, and the problem lists and roll-ups made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import unit_kind
from .common import table
from .relational import first_per_key

#: Plausible bands per kind of unit, and how far a value may be from its history.
MONEY, PER_SHARE, PERCENT, MARGIN = (1.0, 500_000.0), (-500.0, 500.0), (-100.0, 100.0), (-50.0, 100.0)
HISTORY = 0.60


def units_ok(metric: Column, units: Column, value: Column) -> Column:
    kind = unit_kind(units)
    return (
        F.when(kind == "percent", F.when(F.contains(F.lower(metric), F.lit("margin")), value.between(*MARGIN)).otherwise(value.between(*PERCENT)))
        .when(kind == "per_share", value.between(*PER_SHARE)).when(kind == "money", F.abs(value).between(*MONEY)).otherwise(F.lit(True))
    )


def never_negative(metric: Column, units: Column) -> Column:
    return (unit_kind(units) == "money") & F.lower(metric).rlike("sales|revenue|fees")


def checks(values: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(id, check, status) for rows (id, metric, units, value) and, if given, each id's latest (id, last)."""
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    status = lambda ok, bad="fail": F.when(ok, "pass").otherwise(bad)
    rows = [F.struct(F.lit("completeness").alias("check"), status(finite).alias("status"))]
    rows.append(F.struct(F.lit("units").alias("check"), F.when(finite, status(units_ok(F.col("metric"), F.col("units"), F.col("value")))).otherwise("warn").alias("status")))
    rows.append(F.struct(F.lit("sign").alias("check"), F.when(finite, status(~(never_negative(F.col("metric"), F.col("units")) & (F.col("value") <= 0)))).otherwise("warn").alias("status")))
    if history is not None:
        values = values.join(history, "id", "left")
        near = F.abs(F.col("value") - F.col("last")) / F.greatest(F.abs("last"), F.lit(1e-9)) <= HISTORY
        rows.append(F.struct(F.lit("history").alias("check"), F.when(F.col("last").isNull() | ~finite, "warn").otherwise(status(near, "warn")).alias("status")))
    return values.select("id", F.inline(F.array(*rows)))


def rollup(c: DataFrame, by: list[str]) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    g = c.groupBy(*by).agg(F.count("*").alias("total"), n("pass"), n("warn"), n("fail"))
    return g.withColumn("worst", F.when(F.col("fail") > 0, "fail").when(F.col("warn") > 0, "warn").otherwise("pass"))


def margin_checks(revenue: DataFrame, profit: DataFrame, by: list[str]) -> DataFrame:
    """Implied margins of a profit and a revenue in percent, plausible between 0 and 60."""
    j = revenue.withColumnRenamed("value", "r").join(profit.withColumnRenamed("value", "p"), by).where(F.abs("r") >= 1e-9)
    m = F.col("p") / F.col("r") * 100
    return j.select(*by, F.round(m, 4).alias("margin"), F.when((m > 0) & (m < 60), "pass").otherwise("warn").alias("status"))


def problems(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(key, problem): one row for every rule a row breaks; rules are conditions of breach."""
    return df.select(key, F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))).alias("problem"))


#: When an interval is too wide, in points and as a part of the value; how short a method is too short; what a step is.
WIDE_POINTS, WIDE_PART, SHORT_METHOD, STEP = 12.0, 0.5, 40, (0.5, 2.0)


def metric_rules() -> dict[str, Column]:
    """Conditions of breach for a forecast of a metric, for problems().

    They read metric, units, want_metric, want_units, value, low, high, last (the latest comparable figure), method,
    assumptions and sources (arrays of text) and confidence; all but the first three hold only where there is a value.
    """
    v, low, high, last, units = F.col("value"), F.col("low"), F.col("high"), F.col("last"), F.col("want_units")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    there = finite(v)
    percent, share, money = F.trim(units) == "%", F.lower("want_metric").contains("eps") | F.lower(units).contains("share"), F.lower(units).isin("usdm", "gbpm", "eurm")
    both = finite(low) & finite(high)
    width = F.abs(high - low)
    compared = finite(last) & (last != 0) & ~percent
    ratio = v / F.nullif(last, F.lit(0.0))
    method = F.trim(F.coalesce("method", F.lit("")))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    held = {
        "warn: no interval": ~both,
        "error: interval upside down": both & (low > high),
        "error: outside its interval": both & ~v.between(F.least(low, high), F.greatest(low, high)),
        "warn: interval of one point": both & (low == high),
        "warn: interval too wide": both & F.when(percent, width > WIDE_POINTS).otherwise((v != 0) & (width / F.abs(v) > WIDE_PART)),
        "warn: percentage below one": percent & (F.abs(v) < 1) & (v != 0),
        "error: percentage above hundred": percent & (F.abs(v) > 100),
        "error: a trillion or more": money & (F.abs(v) >= 1_000_000),
        "error: share figure above hundred": share & ~money & ~percent & (units != "GBp") & (F.abs(v) > 100),
        "warn: sign changed": compared & (ratio <= 0),
        "warn: step": compared & (ratio > 0) & ~ratio.between(*STEP),
        "error: no method": method == "",
        "warn: short method": (method != "") & (F.length(method) < SHORT_METHOD),
        "warn: no arithmetic": (method != "") & ~method.rlike("[0-9]"),
        "warn: no assumptions": F.coalesce(F.size("assumptions"), F.lit(0)) <= 0,
        "warn: no sources": F.coalesce(F.size("sources"), F.lit(0)) <= 0,
        "warn: blank source": F.exists("sources", blank),
        "warn: no confidence": blank(F.col("confidence")),
    }
    first = {"error: other metric": ~F.col("metric").eqNullSafe(F.col("want_metric")), "error: other units": ~F.col("units").eqNullSafe(units), "error: no value": ~there}
    return first | {k: there & c for k, c in held.items()}


def _anchors(spark, sf_dir) -> DataFrame:
    a = table(spark, sf_dir, "guidance_anchors").select("anchor_id", "series_id", "metric", "units", "value", "captured_at").distinct()
    return a.withColumnRenamed("anchor_id", "id")


def m1_checks(spark, sf_dir):
    a = _anchors(spark, sf_dir)
    last = first_per_key(a, ["series_id"], [F.desc("captured_at"), F.desc("id")]).select("series_id", F.col("value").alias("last"))
    history = a.join(last, "series_id").select("id", "last")
    return checks(a, history)


def g8_rollup(spark, sf_dir):
    a = _anchors(spark, sf_dir)
    return rollup(checks(a).join(a.select("id", "metric"), "id"), ["metric"])


def m1_margin(spark, sf_dir):
    """Part of each quarter's revenue that is discount, as a profit on it."""
    from .timeseries import quarterly_totals

    r = quarterly_totals(spark, sf_dir)
    p = r.select("key", "day", F.when(F.month("day") == 3, -F.col("value") * 0.1).otherwise(F.col("value") * F.month("day") / 15).alias("value"))
    return margin_checks(r, p, ["key", "day"])


def m2_problems(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber"))  # noqa: E741
    rules = {"discount over 9 %": F.col("l_discount") > 0.09, "tax of 8 %": F.col("l_tax") >= 0.08, "large": F.col("l_quantity") >= 49, "price": F.col("l_extendedprice") / F.col("l_quantity") > 2000}
    return problems(l, rules, "key").groupBy("problem").agg(F.count("*").alias("n"), F.countDistinct("key").alias("items"))


def m2_metric_problems(spark, sf_dir):
    """Anchors as forecasts with made intervals and last figures, by what is wrong with them."""
    i = F.col("anchor_id")
    f = table(spark, sf_dir, "guidance_anchors").select("anchor_id", "metric", "units", "value", "context", "source_path").distinct()
    f = f.select(
        "anchor_id", "metric", F.when(i % 9 == 0, "other").otherwise(F.col("metric")).alias("want_metric"), F.when(i % 8 == 0, "USDm").otherwise(F.col("units")).alias("want_units"), "units", "value",
        F.when(i % 7 != 0, F.col("value") - F.abs("value") * (i % 3) / 4).alias("low"), (F.col("value") + F.abs("value") * (i % 4) / 4).alias("high"), (F.col("value") * (i % 5 - 1)).alias("last"),
        F.when(i % 10 != 0, F.substring("context", 1, (i % 60).cast("int"))).alias("method"), F.when(i % 6 != 0, F.array(F.lit("a"))).alias("assumptions"), F.array("source_path").alias("sources"), F.when(i % 4 != 0, "high").alias("confidence"))
    return problems(f, metric_rules(), "anchor_id").groupBy("problem").agg(F.countDistinct("anchor_id").alias("items"))


def m4_tieout(spark, sf_dir):
    """Segments' totals by two ways, agreeing within a tolerance."""
    from .timeseries import quarterly_totals

    a = quarterly_totals(spark, sf_dir).groupBy("key").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("a"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    b = table(spark, sf_dir, "customer").join(o, "c_custkey").groupBy(F.col("c_mktsegment").alias("key")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("b"))
    return a.join(b, "key").select("key", (F.col("a") / 100.0).alias("by_quarter"), (F.col("b") / 100.0).alias("by_order"), (F.abs(F.col("a") - F.col("b")) <= F.abs("b") * 1e-9).alias("ties"))


def m6_postprocess(spark, sf_dir):
    """Documents with an address, once per address, by whether the host is blocked."""
    d = table(spark, sf_dir, "documents").where("source_url is not null")
    d = first_per_key(d.select("doc_id", F.lower("source_url").alias("url"), "source"), ["url"], ["doc_id"])
    return d.groupBy("source").agg(F.count("*").alias("kept"), F.count_if(F.contains("url", F.lit("wexhollow"))).alias("blocked"))


def b6_verify(spark, sf_dir):
    """Metrics of the specification without a figure, and figures without a metric, per ticker."""
    spec = table(spark, sf_dir, "company_metrics").select("ticker", "metric").distinct()
    got = table(spark, sf_dir, "value_candidates").select("ticker", "metric").distinct()
    a = spec.join(got, ["ticker", "metric"], "left_anti").select("ticker", "metric", F.lit("missing").alias("problem"))
    return a.unionByName(got.join(spec, ["ticker", "metric"], "left_anti").select("ticker", "metric", F.lit("unknown").alias("problem")))


QUERIES = {f.__name__: f for f in (m1_checks, g8_rollup, m1_margin, m2_problems, m2_metric_problems, m4_tieout, m6_postprocess, b6_verify)}
_K = "case when units = '%' then 'percent' when units in ('USD / share', 'EUR / share', 'GBP / share', 'GBp') then 'per_share' when units in ('USDm', 'GBPm', 'EURm') then 'money' else 'unknown' end"
_A = f"a as (select distinct anchor_id as id, series_id, metric, units, value, captured_at, {_K} as kind, isfinite(value) as fin from guidance_anchors)"
_CK = """b as (select *, case kind when 'percent' then case when contains(lower(metric), 'margin') then value between -50 and 100 else value between -100 and 100 end when 'per_share' then value between -500 and 500 when 'money' then abs(value) between 1 and 500000 else true end as u, kind = 'money' and regexp_matches(lower(metric), 'sales|revenue|fees') and value <= 0 as neg from a),
c as (select id, metric, series_id, value, fin, 'completeness' as "check", case when coalesce(fin, false) then 'pass' else 'fail' end as status from b union all select id, metric, series_id, value, fin, 'units', case when coalesce(fin, false) then case when u then 'pass' else 'fail' end else 'warn' end from b union all select id, metric, series_id, value, fin, 'sign', case when coalesce(fin, false) then case when neg then 'fail' else 'pass' end else 'warn' end from b)"""
_P = "p as (select c_mktsegment as key, cast(date_trunc('quarter', o_orderdate) + interval 3 month - interval 1 day as date) as day, sum(cast(round(o_totalprice * 100) as bigint)) as cents from orders join customer on o_custkey = c_custkey group by 1, 2)"
ORACLES = {
    "m1_checks": f"with {_A}, {_CK}, l as (select series_id, value as last from (select *, row_number() over (partition by series_id order by captured_at desc, id desc) as k from a) where k = 1) select id, \"check\", status from c union all select id, 'history', case when last is null or not coalesce(fin, false) then 'warn' when abs(value - last) / greatest(abs(last), 1e-9) <= 0.6 then 'pass' else 'warn' end from a left join l using (series_id)",
    "g8_rollup": f"with {_A}, {_CK} select metric, count(*) as total, count(*) filter (status = 'pass') as \"pass\", count(*) filter (status = 'warn') as warn, count(*) filter (status = 'fail') as fail, case when count(*) filter (status = 'fail') > 0 then 'fail' when count(*) filter (status = 'warn') > 0 then 'warn' else 'pass' end as worst from c group by 1",
    "m1_margin": f"with {_P}, q as (select key, day, cents / 100.0 as r, case when month(day) = 3 then -(cents / 100.0) * 0.1 else (cents / 100.0) * month(day) / 15 end as v from p) select key, day, round(v / r * 100, 4) as margin, case when v / r * 100 > 0 and v / r * 100 < 60 then 'pass' else 'warn' end as status from q",
    "m2_problems": "with x as (select l_orderkey || '-' || l_linenumber as key, unnest(list_filter([case when l_discount > 0.09 then 'discount over 9 %' end, case when l_tax >= 0.08 then 'tax of 8 %' end, case when l_quantity >= 49 then 'large' end, case when l_extendedprice / l_quantity > 2000 then 'price' end], lambda z: z is not null)) as problem from lineitem) select problem, count(*) as n, count(distinct key) as items from x group by 1",
    "m2_metric_problems": """with g as (select distinct anchor_id as i, metric, units, value as v, context, source_path from guidance_anchors),
f as (select i, metric, units, v, isfinite(v) as ok, source_path, case when i % 9 = 0 then 'other' else metric end as wm, case when i % 8 = 0 then 'USDm' else units end as wu, case when i % 7 <> 0 then v - abs(v) * (i % 3) / 4 end as lo, v + abs(v) * (i % 4) / 4 as hi, v * (i % 5 - 1) as last,
  trim(coalesce(case when i % 10 <> 0 then substring(context, 1, cast(i % 60 as integer)) end, '')) as m from g),
h as (select *, wu = '%' as pct, contains(lower(wm), 'eps') or contains(lower(wu), 'share') as share, lower(wu) in ('usdm', 'gbpm', 'eurm') as money, lo is not null and isfinite(lo) and isfinite(hi) as iv, last <> 0 and wu <> '%' as cmp from f),
x as (select i, unnest([case when metric is distinct from wm then 'error: other metric' end, case when units is distinct from wu then 'error: other units' end, case when not coalesce(ok, false) then 'error: no value' end,
  case when ok and not iv then 'warn: no interval' end, case when ok and iv and lo > hi then 'error: interval upside down' end, case when ok and iv and not (v between least(lo, hi) and greatest(lo, hi)) then 'error: outside its interval' end, case when ok and iv and lo = hi then 'warn: interval of one point' end,
  case when ok and iv and (case when pct then abs(hi - lo) > 12 else v <> 0 and abs(hi - lo) / abs(v) > 0.5 end) then 'warn: interval too wide' end, case when ok and pct and abs(v) < 1 and v <> 0 then 'warn: percentage below one' end, case when ok and pct and abs(v) > 100 then 'error: percentage above hundred' end,
  case when ok and money and abs(v) >= 1000000 then 'error: a trillion or more' end, case when ok and share and not money and not pct and wu <> 'GBp' and abs(v) > 100 then 'error: share figure above hundred' end,
  case when ok and cmp and v / last <= 0 then 'warn: sign changed' end, case when ok and cmp and v / last > 0 and not (v / last between 0.5 and 2.0) then 'warn: step' end,
  case when ok and m = '' then 'error: no method' end, case when ok and m <> '' and length(m) < 40 then 'warn: short method' end, case when ok and m <> '' and not regexp_matches(m, '[0-9]') then 'warn: no arithmetic' end,
  case when ok and i % 6 = 0 then 'warn: no assumptions' end, case when ok and coalesce(trim(source_path), '') = '' then 'warn: blank source' end, case when ok and i % 4 = 0 then 'warn: no confidence' end]) as problem from h)
select problem, count(distinct i) as items from x where problem is not null group by 1""",
    "m4_tieout": f"with {_P}, a as (select key, sum(cents) as c from p group by 1) select key, c / 100.0 as by_quarter, c / 100.0 as by_order, true as ties from a",
    "m6_postprocess": "with d as (select distinct on (lower(source_url)) lower(source_url) as url, source from documents where source_url is not null order by lower(source_url), doc_id) select source, count(*) as kept, count(*) filter (contains(url, 'wexhollow')) as blocked from d group by 1",
    "b6_verify": "with s as (select distinct ticker, metric from company_metrics), g as (select distinct ticker, metric from value_candidates) select *, 'missing' as problem from (select * from s except select * from g) union all select *, 'unknown' from (select * from g except select * from s)",
}
