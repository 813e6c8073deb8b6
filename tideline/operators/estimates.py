"""Rules on finished estimates: anchors, confidence, acceptance, plans, market data and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .quality import problems, units_ok
from .relational import first_per_key, upper_median

RANK = {"guidance": 3, "consensus": 2, "last_actual": 1}


def quarter_of(period: Column) -> Column:
    return F.nullif(F.regexp_extract(F.upper(period), "Q([1-4])", 1), F.lit(""))


def year_of(period: Column) -> Column:
    return F.nullif(F.regexp_extract(F.upper(period), "(20[0-9]{2})", 1), F.lit(""))


def same_shape(a: Column, b: Column) -> Column:
    """The same quarter, or no quarter in either."""
    return quarter_of(a).eqNullSafe(quarter_of(b))


def same_period(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull() & year_of(a).eqNullSafe(year_of(b)) & same_shape(a, b)


def pick_anchor(anchors: DataFrame, by: list[str], order: list) -> DataFrame:
    """Per group the anchor (kind, value) of the best kind; the first in order of equals."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[F.col("kind")], F.lit(0))
    return first_per_key(anchors.where("value is not null").withColumn("_rank", rank), by, [F.desc("_rank"), *order]).drop("_rank")


def confidence(agreement: Column, anchored: Column, outliers: Column, clamped: Column, inside: Column, plausible: Column, corrected: Column) -> Column:
    """high, medium or low, from what the methods, the anchor and the critic say."""
    level = F.when(anchored | (agreement >= 0.9), 2).when(agreement >= 0.7, 1).otherwise(0)
    lowered = F.when((outliers | clamped) & ~inside & (level == 2), 1).otherwise(level)
    objected = F.when(~corrected, 0).when(inside, 2).otherwise(1)
    return F.get(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.when(F.coalesce(plausible, F.lit(True)), lowered).otherwise(objected))


def critic_bound(value: Column, plausible: Column, low: Column, high: Column) -> Column:
    return F.when(~F.coalesce(plausible, F.lit(True)) & low.isNotNull() & high.isNotNull(), F.greatest(low, F.least(high, value))).otherwise(value)


def accept(metric: Column, units: Column, value: Column, derivation: Column, citations: Column, latest: Column) -> Column:
    """Why a proposal is rejected, the first reason that applies; null if it is accepted."""
    from .quality import never_negative

    return (
        F.when(~units_ok(metric, units, value), "units").when(never_negative(metric, units) & (value <= 0), "sign").when(F.coalesce(F.trim(derivation), F.lit("")) == "", "derivation")
        .when(F.coalesce(F.size(citations), F.lit(0)) <= 0, "citations").when((F.abs(latest) > 1e-9) & (F.abs(value - latest) / F.abs(latest) > 3.0), "series")
    )


def pick_model(models: DataFrame, small: bool) -> DataFrame:
    """The newest usable model name of a tier: highest version, plain names before -pro; dated and special ones left out."""
    v = lambda k: F.coalesce(F.nullif(F.regexp_extract("model", r"^[a-z]+-([0-9]+)(?:\.([0-9]+))?", k), F.lit("")).cast("int"), F.lit(0))
    ok = ~F.contains("model", F.lit("-202")) & ~F.contains("model", F.lit("chat-latest")) & (v(1) > 0) & (F.col("model").rlike("mini|nano|small") == F.lit(small))
    return models.where(ok).orderBy(F.struct(v(1), v(2), ~F.contains("model", F.lit("-pro"))).desc(), "model").limit(1)


def _anchors(spark, sf_dir) -> DataFrame:
    a = table(spark, sf_dir, "guidance_anchors").select("anchor_id", "series_id", "ticker", "metric", "units", "value", "source_path").distinct()
    kind = F.when(F.col("anchor_id") % 5 == 0, "guidance").when(F.col("anchor_id") % 5 == 1, "consensus").when(F.col("anchor_id") % 5 == 2, "last_actual").otherwise("derived")
    return a.withColumn("kind", kind)


def c19_period_shape(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "period")
    t = F.lit("FY2025 Q2")
    return d.select("doc_id", same_period(F.col("period"), t).alias("same_period"), same_shape(F.coalesce("period", F.lit("")), t).alias("same_shape"))


def l12_pick_anchor(spark, sf_dir):
    return pick_anchor(_anchors(spark, sf_dir), ["series_id"], [F.asc("anchor_id")]).select("series_id", "anchor_id", "kind")


def l13_critic(spark, sf_dir):
    a = _anchors(spark, sf_dir).where("value is not null")
    v = critic_bound(F.col("value") * 1.2, F.col("anchor_id") % 2 == 0, F.col("value") * 0.9, F.col("value") * 1.1)
    return a.select("anchor_id", F.round(v, 6).alias("value"))


def l14_confidence(spark, sf_dir):
    a = _anchors(spark, sf_dir)
    i = F.col("anchor_id")
    c = confidence((i % 10) / 10.0, F.col("kind").isin("guidance", "consensus"), i % 3 == 0, i % 7 == 0, i % 4 == 0, i % 11 != 0, i % 2 == 0)
    return a.select("anchor_id", c.alias("confidence"))


def l15_consensus(spark, sf_dir):
    """Consensus anchors for the metrics the market quotes: earnings per share, and revenue-like money."""
    m = table(spark, sf_dir, "company_metrics").select("ticker", "metric", "units").distinct()
    snap = table(spark, sf_dir, "company_metrics").select("ticker").distinct().withColumn("eps_avg", F.length("ticker") * 1.5).withColumn("revenue_avg_m", F.when(F.col("ticker") > "M", F.lit(100.0)))
    kind = F.when(F.contains("units", F.lit("share")) | (F.col("units") == "GBp"), "per_share").when(F.col("units") == "%", "percent").otherwise("money")
    v = F.when(kind == "per_share", F.col("eps_avg")).when((kind == "money") & F.lower("metric").rlike("sales|revenue|fees"), F.col("revenue_avg_m"))
    return m.join(snap, "ticker").select("ticker", "metric", v.alias("value")).where("value is not null")


def l17_revisions(spark, sf_dir):
    """Change of the estimate against a while ago in percent, zero meaning absent."""
    e = table(spark, sf_dir, "value_candidates").select("candidate_id", "value", "score").distinct()
    now, ago = F.nullif("value", F.lit(0.0)), F.nullif(F.round("score", 0), F.lit(0.0))
    return e.select("candidate_id", F.round((now / ago - 1) * 100, 6).alias("change"))


def m3_unit_warnings(spark, sf_dir):
    a = _anchors(spark, sf_dir).where("value is not null")
    rules = {"percent as fraction": (F.col("units") == "%") & (F.abs("value") < 1), "millions as units": F.col("units").isin("USDm", "EURm", "GBPm") & (F.abs("value") > 500_000), "share in cents": F.contains("units", F.lit("share")) & (F.abs("value") > 100)}
    return problems(a, rules, "anchor_id")


def m5_acceptance(spark, sf_dir):
    a = _anchors(spark, sf_dir)
    i = F.col("anchor_id")
    why = accept(F.col("metric"), F.col("units"), F.col("value"), F.when(i % 9 != 0, F.lit("from filings")), F.when(i % 8 != 0, F.array(F.col("source_path"))), F.when(i % 2 == 0, F.col("value") / F.when(i % 6 == 0, 5.0).otherwise(1.1)))
    return a.select("anchor_id", why.alias("reason"))


def m7_plan(spark, sf_dir):
    """Per company the metrics a plan lacks and the tickers nobody knows."""
    spec = table(spark, sf_dir, "company_metrics").select("ticker", "metric").distinct()
    have = table(spark, sf_dir, "guidance_anchors").select("ticker", "metric").distinct().where("metric <> 'Net income'")
    lack = spec.join(have, ["ticker", "metric"], "left_anti").groupBy("ticker").agg(F.count("*").alias("n")).select("ticker", F.lit("metrics missing").alias("problem"), "n")
    odd = have.join(spec.select("ticker").distinct(), "ticker", "left_anti").groupBy("ticker").agg(F.count("*").alias("n")).select("ticker", F.lit("unknown ticker").alias("problem"), "n")
    return lack.unionByName(odd)


def g11_coverage(spark, sf_dir):
    """Rows per channel of each series, and which series are thin."""
    parts = [table(spark, sf_dir, t).select("series_id", F.lit(c).alias("channel"), F.col(k).alias("id")) for t, c, k in (("guidance_anchors", "guidance", "anchor_id"), ("evidence", "evidence", "evidence_id"))]
    u = parts[0].unionByName(parts[1]).where("series_id is not null").distinct()
    p = u.groupBy("series_id").pivot("channel", ["guidance", "evidence"]).count().na.fill(0)
    return p.select("series_id", "guidance", "evidence", (F.col("guidance") < 4).alias("thin"))


def g16_market_gap(spark, sf_dir):
    """The upper median of the absolute relative gaps of evidence to its series' mean."""
    e = table(spark, sf_dir, "guidance_anchors").where("value is not null").select("anchor_id", "series_id", "value").distinct()
    m = e.groupBy("series_id").agg(F.median("value").alias("m")).where("abs(m) > 1e-9")
    g = e.join(m, "series_id").select("series_id", F.abs((F.col("value") - F.col("m")) / F.abs("m")).alias("gap"))
    return g.groupBy("series_id").agg(F.round(upper_median("gap"), 6).alias("gap"))


def g19_coverage(spark, sf_dir):
    """Upside of the mean of a series' figures over its first one, in percent, and how many there are of each kind."""
    a = _anchors(spark, sf_dir).where("value is not null")
    g = a.groupBy("series_id").agg(F.avg("value").alias("mean"), F.min(F.struct("anchor_id", "value")).alias("f"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("guidance", "consensus", "last_actual")])
    return g.select("series_id", F.round((F.col("mean") / F.nullif(F.col("f.value"), F.lit(0.0)) - 1) * 100, 4).alias("upside"), "guidance", "consensus", "last_actual")


def i7_pick_model(spark, sf_dir):
    m = spark.createDataFrame([(x,) for x in ("model-4.1", "model-4.1-mini", "model-5", "model-5-pro", "model-5-2025-08-07", "model-5-mini", "chat-latest", "other")], "model string")
    return pick_model(m, False).unionByName(pick_model(m, True))


QUERIES = {f.__name__: f for f in (c19_period_shape, l12_pick_anchor, l13_critic, l14_confidence, l15_consensus, l17_revisions, m3_unit_warnings, m5_acceptance, m7_plan, g11_coverage, g16_market_gap, g19_coverage, i7_pick_model)}
_A = "a as (select distinct anchor_id, series_id, ticker, metric, units, value, source_path, case anchor_id % 5 when 0 then 'guidance' when 1 then 'consensus' when 2 then 'last_actual' else 'derived' end as kind from guidance_anchors)"
_K = "case when units = '%' then 'percent' when units in ('USD / share', 'EUR / share', 'GBP / share', 'GBp') then 'per_share' when units in ('USDm', 'GBPm', 'EURm') then 'money' else 'unknown' end"
_UOK = f"(case {_K} when 'percent' then case when contains(lower(metric), 'margin') then value between -50 and 100 else value between -100 and 100 end when 'per_share' then value between -500 and 500 when 'money' then abs(value) between 1 and 500000 else true end)"
_QQ = "nullif(regexp_extract(upper(period), 'Q([1-4])', 1), '')"
ORACLES = {
    "c19_period_shape": f"select doc_id, period is not null and nullif(regexp_extract(upper(period), '(20[0-9]{{2}})', 1), '') is not distinct from '2025' and {_QQ} is not distinct from '2' as same_period, {_QQ} is not distinct from '2' as same_shape from documents",
    "l12_pick_anchor": f"with {_A} select series_id, anchor_id, kind from (select *, row_number() over (partition by series_id order by case kind when 'guidance' then 3 when 'consensus' then 2 when 'last_actual' then 1 else 0 end desc, anchor_id) as k from a where value is not null) where k = 1",
    "l13_critic": f"with {_A} select anchor_id, round(case when anchor_id % 2 = 0 then value * 1.2 else greatest(value * 0.9, least(value * 1.1, value * 1.2)) end, 6) as value from a where value is not null",
    "l14_confidence": f"with {_A}, b as (select anchor_id, case when kind in ('guidance', 'consensus') or (anchor_id % 10) / 10.0 >= 0.9 then 2 when (anchor_id % 10) / 10.0 >= 0.7 then 1 else 0 end as lv, anchor_id % 4 = 0 as ins from a), c as (select anchor_id, case when anchor_id % 11 <> 0 then case when (anchor_id % 3 = 0 or anchor_id % 7 = 0) and not ins and lv = 2 then 1 else lv end when anchor_id % 2 <> 0 then 0 when ins then 2 else 1 end as z from b) select anchor_id, ['low', 'medium', 'high'][z + 1] as confidence from c",
    "l15_consensus": "select ticker, metric, cast(case when contains(units, 'share') or units = 'GBp' then length(ticker) * 1.5 when units <> '%' and regexp_matches(lower(metric), 'sales|revenue|fees') and ticker > 'M' then 100.0 end as double) as value from (select distinct ticker, metric, units from company_metrics) where value is not null",
    "l17_revisions": "select distinct candidate_id, round((nullif(value, 0) / nullif(round(score, 0), 0) - 1) * 100, 6) as change from value_candidates",
    "m3_unit_warnings": f"with {_A} select anchor_id, 'percent as fraction' as problem from a where units = '%' and abs(value) < 1 union all select anchor_id, 'millions as units' from a where units in ('USDm', 'EURm', 'GBPm') and abs(value) > 500000 union all select anchor_id, 'share in cents' from a where contains(units, 'share') and abs(value) > 100",
    "m5_acceptance": f"with {_A} select anchor_id, case when not {_UOK} then 'units' when {_K} = 'money' and regexp_matches(lower(metric), 'sales|revenue|fees') and value <= 0 then 'sign' when anchor_id % 9 = 0 then 'derivation' when anchor_id % 8 = 0 then 'citations' when anchor_id % 6 = 0 and abs(value / 5) > 1e-9 and abs(value - value / 5) / abs(value / 5) > 3 then 'series' end as reason from a",
    "m7_plan": "with s as (select distinct ticker, metric from company_metrics), h as (select distinct ticker, metric from guidance_anchors where metric <> 'Net income') select ticker, 'metrics missing' as problem, count(*) as n from (select * from s except select * from h) group by 1 union all select ticker, 'unknown ticker', count(*) from h where ticker not in (select ticker from s) group by 1",
    "g11_coverage": "with u as (select distinct series_id, anchor_id as id, 'g' as c from guidance_anchors where series_id is not null union select distinct series_id, evidence_id, 'e' from evidence where series_id is not null) select series_id, count(*) filter (c = 'g') as guidance, count(*) filter (c = 'e') as evidence, count(*) filter (c = 'g') < 4 as thin from u group by 1",
    "g16_market_gap": "with e as (select distinct anchor_id, series_id, value from guidance_anchors where value is not null), m as (select series_id, median(value) as m from e group by 1 having abs(median(value)) > 1e-9), g as (select series_id, abs((value - m) / abs(m)) as gap from e join m using (series_id)), r as (select *, row_number() over (partition by series_id order by gap) as k, count(*) over (partition by series_id) as n from g) select series_id, round(max(case when k = n // 2 + 1 then gap end), 6) as gap from r group by 1",
    "g19_coverage": f"with {_A} select series_id, round((avg(value) / nullif(min_by(value, anchor_id), 0) - 1) * 100, 4) as upside, count(*) filter (kind = 'guidance') as guidance, count(*) filter (kind = 'consensus') as consensus, count(*) filter (kind = 'last_actual') as last_actual from a where value is not null group by 1",
    "i7_pick_model": "select 'model-5' as model union all select 'model-5-mini'",
}
