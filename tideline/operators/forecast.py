"""Forecasts, their replay under cutoffs, and the rules that combine and judge independent estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .timeseries import QUARTER_DAYS, SERIES_SQL, YEAR_TOLERANCE, growth, quarterly_totals

#: The guidance blend, the weak line, score limits, agreement bands, outlier rules and weights.
GUIDANCE_WEIGHT, GUIDANCE_REJECT = 0.65, 0.40
WEAK = 0.15
WORST_SCORE, FLOOR_POINTS, FLOOR_PART = 5.0, 0.5, 0.005
TIGHT, MODERATE, OUTLIER_RATIO = 0.05, 0.20, 2.0
BASE = {"guidance": 1.0, "statistical": 0.8, "qualitative": 0.6}
CONFIDENCE = {"high": 1.0, "medium": 0.7, "low": 0.4}
FAR_FROM_MEDIAN, FAR_FACTOR, BAND = 0.35, 0.25, 0.05
ANCHOR = {"guidance": 1.2, "consensus": 0.9, "last_actual": 0.7}
BIAS_LEAST, BIAS_MIN, BIAS_MAX = 4, 0.01, 0.25


def replay(points: DataFrame, events: DataFrame) -> DataFrame:
    """The seasonal naive forecast of every event (key, event, cutoff), from points no later than its cutoff only.

    All events run in one plan: points meet the events of their series that may see them, the latest visible point is
    an aggregate, and the two earlier points it asks for are found in one more pass.
    """
    seen = events.join(points, "key").where("day <= cutoff")
    last = seen.groupBy("key", "event", "cutoff").agg(F.max(F.struct("day", "value")).alias("last"), F.count("*").alias("observations"))
    j = seen.select("key", "event", "day", "value").join(last, ["key", "event"])
    near = lambda target: F.min(F.when(F.abs(F.date_diff("day", target)) <= YEAR_TOLERANCE, F.struct(F.abs(F.date_diff("day", target)).alias("gap"), "day", "value")))
    g = j.groupBy("key", "event", "cutoff", "last", "observations").agg(
        near(F.date_sub(F.col("last.day"), 365)).alias("ago"), near(F.date_sub(F.date_add(F.col("last.day"), QUARTER_DAYS), 365)).alias("prior"))
    rate = growth(F.col("last.value"), F.col("ago.value"))
    prior = F.col("prior.value")
    value = F.coalesce(prior * (1 + rate), prior, F.col("last.value") * (1 + rate), F.col("last.value"))
    how = F.when(prior.isNotNull() & rate.isNotNull(), "seasonal naive with drift").when(prior.isNotNull(), "seasonal naive").when(rate.isNotNull(), "persistence with drift").otherwise("persistence")
    sure = F.when((F.col("observations") >= 8) & prior.isNotNull(), "medium").otherwise("low")
    return g.select("key", "event", "cutoff", value.alias("forecast"), how.alias("method"), sure.alias("confidence"), "observations")


def blend(statistical: Column, anchor: Column) -> Column:
    """Guidance and the statistical estimate weighed; guidance too far away, or absent, is left out."""
    far = F.abs(anchor - statistical) / F.greatest(F.abs(statistical), F.lit(1e-9)) > GUIDANCE_REJECT
    return F.when(anchor.isNull() | far, statistical).otherwise(GUIDANCE_WEIGHT * anchor + (1 - GUIDANCE_WEIGHT) * statistical)


def bias_factor(observations: Column, median: Column) -> Column:
    """1 plus the measured bias, kept within limits; 1 where there are too few observations or too little bias."""
    return F.when((observations >= BIAS_LEAST) & (F.abs(median) >= BIAS_MIN), 1 + F.greatest(F.lit(-BIAS_MAX), F.least(F.lit(BIAS_MAX), median))).otherwise(F.lit(1.0))


def summarise(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Errors of (forecast, actual) per group: counts, medians, means, extremes, and the part within 5 %."""
    e = outcomes.withColumn("err", F.abs(F.col("forecast") - F.col("actual"))).withColumn("pct", F.when(F.abs("actual") >= 1e-9, F.abs(F.col("forecast") - F.col("actual")) / F.abs("actual")))
    return e.groupBy(*by).agg(
        F.count("*").alias("events"), F.round(F.median("err"), 4).alias("median_error"), F.round(F.median("pct"), 6).alias("median_pct"), F.round(F.avg("pct"), 6).alias("mean_pct"),
        F.round(F.min("pct"), 6).alias("min_pct"), F.round(F.max("pct"), 6).alias("max_pct"), F.when(F.count("*") >= 2, F.round(F.avg((F.col("pct") <= 0.05).cast("int")), 4)).alias("within_5pct"))


def score(forecast: Column, actual: Column, units: Column, reference_error: Column) -> Column:
    """Error against the reference's, floored, at most 5; a missing forecast scores 5."""
    floor = F.when(units.contains("%"), F.lit(FLOOR_POINTS)).otherwise(F.greatest(F.abs(actual) * FLOOR_PART, F.lit(1e-6)))
    return F.coalesce(F.least(F.lit(WORST_SCORE), F.abs(forecast - actual) / F.greatest(reference_error, floor)), F.lit(WORST_SCORE))


def ensemble(estimates: DataFrame, by: list[str]) -> DataFrame:
    """One value per group from (source, value): itself, the mean of two, or of three the two that agree, else the median.

    Of three, an end whose distance from the middle is more than OUTLIER_RATIO times the other's is dropped; of more
    than three the median holds.
    """
    g = estimates.where("value is not null").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("value", "source"))).alias("m"), F.median("value").alias("median"), (F.max("value") - F.min("value")).alias("width"))
    v = lambda i: F.get("m", F.lit(i))["value"]
    n, low, high = F.size("m"), v(1) - v(0), v(2) - v(1)
    top, bottom = high > OUTLIER_RATIO * F.greatest(low, F.lit(1e-12)), low > OUTLIER_RATIO * F.greatest(high, F.lit(1e-12))
    three = F.when(top, (v(0) + v(1)) / 2).when(bottom, (v(1) + v(2)) / 2).otherwise(v(1))
    value = F.when(n == 1, v(0)).when(n == 2, (v(0) + v(1)) / 2).when(n == 3, three).otherwise(F.col("median"))
    dropped = F.when((n == 3) & top, F.get("m", F.lit(2))["source"]).when((n == 3) & bottom, F.get("m", F.lit(0))["source"])
    spread = F.when(n == 1, 0.0).otherwise(F.col("width") / F.greatest(F.abs("median"), F.lit(1e-9)))
    band = F.when(n == 1, "single").when(spread <= TIGHT, "tight").when(spread <= MODERATE, "moderate").otherwise("wide")
    return g.select(*by, n.alias("members"), value.alias("value"), dropped.alias("dropped"), spread.alias("spread"), band.alias("agreement"))


def _table_of(values: dict[str, float], c: Column, default: float) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[c], F.lit(default))


def reconcile(proposals: DataFrame, anchors: DataFrame, by: list[str]) -> DataFrame:
    """Weighted value per group from (method, value, confidence) and at most one anchor (kind, anchor, low, high, lo, hi).

    Weights come from the method and its confidence and fall far from the median; the anchor joins with its own weight;
    company guidance bounds the result to its range, or a band around its point; lo and hi, the extremes of history,
    widened by their distance, bound it last.
    """
    median = proposals.groupBy(*by).agg(F.median("value").alias("med"))
    p = proposals.join(median, by)
    off = F.when(F.col("med") == 0, F.abs("value")).otherwise(F.abs(F.col("value") - F.col("med")) / F.abs("med"))
    w = _table_of(BASE, F.col("method"), 0.5) * _table_of(CONFIDENCE, F.col("confidence"), 0.7) * F.when(off > FAR_FROM_MEDIAN, FAR_FACTOR).otherwise(1.0)
    s = p.groupBy(*by).agg(F.sum(F.col("value") * w).alias("vw"), F.sum(w).alias("w"), F.max("value").alias("most"), F.first("med").alias("med"), F.count_if(off > FAR_FROM_MEDIAN).alias("outliers"))
    a = s.join(anchors, by, "left")
    aw = F.when(F.col("anchor").isNotNull(), _table_of(ANCHOR, F.col("kind"), 0.0)).otherwise(0.0)
    mean = (F.col("vw") + aw * F.coalesce("anchor", F.lit(0.0))) / (F.col("w") + aw)
    guided = F.col("kind").eqNullSafe(F.lit("guidance"))
    low = F.coalesce(F.least("low", "high"), F.col("anchor") * (1 - BAND))
    high = F.coalesce(F.greatest("low", "high"), F.col("anchor") * (1 + BAND))
    bound = F.when(guided, F.least(F.greatest(mean, low), high)).otherwise(mean)
    span = F.coalesce(F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.nullif(F.abs("hi"), F.lit(0.0)), F.lit(1.0))
    kept = F.when(F.col("lo").isNull(), bound).otherwise(F.least(F.greatest(bound, F.col("lo") - span), F.col("hi") + span))
    most = F.greatest("most", F.when(aw > 0, F.col("anchor")))
    spread = F.when(F.col("med") == 0, F.abs(most)).otherwise(F.abs(most - F.col("med")) / F.abs("med"))
    return a.select(*by, F.round(kept, 4).alias("value"), "outliers", (bound != mean).alias("bounded"), (kept != bound).alias("clamped"), F.round(1 - F.least(spread, F.lit(1.0)), 3).alias("agreement"))


def ladder(forecast: Column, low: Column, high: Column, band_low: Column, band_high: Column) -> tuple[Column, Column]:
    """The first usable of the forecast, the midpoint, an end, the band's midpoint and 0, and where it came from."""
    fine = lambda c: F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c)
    f, lo, hi, a, b = map(fine, (forecast, low, high, band_low, band_high))
    value = F.coalesce(f, (lo + hi) / 2, lo, hi, (a + b) / 2, F.lit(0.0))
    source = F.when(f.isNotNull(), "forecast").when(lo.isNotNull() & hi.isNotNull(), "midpoint").when(lo.isNotNull() | hi.isNotNull(), "endpoint").when(a.isNotNull() & b.isNotNull(), "band").otherwise("zero")
    return value, source


def _events(points: DataFrame, n: int = 8) -> DataFrame:
    """The newest n points of each series as events, with the day before as cutoff."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("day")))
    return points.withColumn("k", k).where(F.col("k") <= n).select("key", F.col("day").alias("event"), F.date_sub("day", 1).alias("cutoff"))


def _outcomes(spark, sf_dir) -> DataFrame:
    p = quarterly_totals(spark, sf_dir)
    actual = p.select("key", F.col("day").alias("event"), F.col("value").alias("actual"))
    return replay(p, _events(p)).join(actual, ["key", "event"])


def _systems(spark, sf_dir) -> DataFrame:
    """Three estimates of each event: the last value, the replay, and the last value grown by the mean of the last four."""
    from pyspark.sql import Window

    p = quarterly_totals(spark, sf_dir)
    by = Window.partitionBy("key").orderBy("day")
    b = p.withColumn("naive", F.lag("value").over(by)).withColumn("drift", F.avg("value").over(by.rowsBetween(-4, -1)))
    b = b.select("key", F.col("day").alias("event"), "naive", "drift").where("naive is not null")
    r = replay(p, _events(p)).select("key", "event", "forecast")
    return r.join(b, ["key", "event"]).select("key", "event", F.explode(F.array(*[F.struct(F.lit(n).alias("source"), F.col(c).alias("value")) for n, c in (("naive", "naive"), ("seasonal", "forecast"), ("drift", "drift"))])).alias("s")).select("key", "event", "s.source", "s.value")


def l2_seasonal_naive(spark, sf_dir):
    p = quarterly_totals(spark, sf_dir)
    now = p.groupBy("key").agg(F.max("day").alias("event")).withColumn("cutoff", F.col("event"))
    return replay(p, now).select("key", F.round("forecast", 4).alias("forecast"), "method", "confidence", "observations")


def l3_blend(spark, sf_dir):
    o = _outcomes(spark, sf_dir)
    return o.select("key", "event", F.round(blend(F.col("forecast"), F.col("actual") * 1.3), 4).alias("blended"))


def l5_bias_factor(spark, sf_dir):
    from .timeseries import bias, guided_totals

    p = quarterly_totals(spark, sf_dir)
    return bias(p, guided_totals(p)).select("key", F.round(bias_factor(F.col("observations"), F.col("median_surprise")), 6).alias("factor"))


def l7_backtest(spark, sf_dir):
    return _outcomes(spark, sf_dir).select("key", "event", "cutoff", F.round("forecast", 4).alias("forecast"), "actual", "method")


def g2_backtest_summary(spark, sf_dir):
    return summarise(_outcomes(spark, sf_dir), ["key"])


def g2_overall(spark, sf_dir):
    """The median of the series' median errors."""
    return summarise(_outcomes(spark, sf_dir), ["key"]).agg(F.count("*").alias("series"), F.sum("events").alias("events"), F.round(F.median("median_pct"), 6).alias("median_of_medians"))


def l8_weak(spark, sf_dir):
    return summarise(_outcomes(spark, sf_dir), ["key"]).where(F.col("median_pct").isNull() | (F.col("median_pct") > WEAK)).select("key", "median_pct")


def l9_score(spark, sf_dir):
    o = _outcomes(spark, sf_dir)
    ref = F.abs(F.col("actual")) * 0.03
    return o.select("key", "event", F.round(score(F.col("forecast"), F.col("actual"), F.lit("USDm"), ref), 6).alias("score"))


def l10_ensemble(spark, sf_dir):
    e = ensemble(_systems(spark, sf_dir), ["key", "event"])
    return e.select("key", "event", "members", F.round("value", 4).alias("value"), "dropped", F.round("spread", 6).alias("spread"), "agreement")


def g4_ensemble_summary(spark, sf_dir):
    e = ensemble(_systems(spark, sf_dir), ["key", "event"])
    return e.groupBy("agreement").agg(F.count("*").alias("n"), F.count("dropped").alias("dropped"), F.round(F.median("spread"), 6).alias("median_spread"))


def l11_reconcile(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for x in ("naive", "qualitative", "seasonal", "guidance", "drift", "statistical")])
    sure = F.when(F.col("source") == "seasonal", "high").when(F.col("source") == "drift", "medium").otherwise("low")
    p = _systems(spark, sf_dir).select("key", "event", names[F.col("source")].alias("method"), "value", sure.alias("confidence"))
    points = quarterly_totals(spark, sf_dir)
    history = points.groupBy("key").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    a = points.join(history, "key").select("key", F.col("day").alias("event"), F.lit("guidance").alias("kind"), (F.col("value") * 1.02).alias("anchor"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), "lo", "hi")
    return reconcile(p, a, ["key", "event"]).select("key", "event", "value", "outliers", "bounded", "clamped", "agreement")


def l16_ladder(spark, sf_dir):
    v = table(spark, sf_dir, "value_candidates").select("candidate_id", "value", "score", "currency").distinct()
    f = F.when(F.col("currency") == "$", F.col("value"))
    lo, hi = F.when(F.col("currency") == "€", F.col("value")), F.when((F.col("currency") == "€") & (F.col("score") > 5), F.col("value") * 2)
    band = F.when(F.col("currency") == "£", F.col("value"))
    value, source = ladder(f, lo, hi, band, band * 3)
    return v.select("candidate_id", F.round(value, 6).alias("value"), source.alias("source"))


def g3_errors(spark, sf_dir):
    o = _outcomes(spark, sf_dir)
    return o.select("key", "event", F.round(F.abs(F.col("forecast") - F.col("actual")), 4).alias("error"), F.round(F.abs(F.col("forecast") - F.col("actual")) / F.abs("actual"), 8).alias("pct"))


QUERIES = {f.__name__: f for f in (l2_seasonal_naive, l3_blend, l5_bias_factor, l7_backtest, g2_backtest_summary, g2_overall, l8_weak, l9_score, l10_ensemble, g4_ensemble_summary, l11_reconcile, l16_ladder, g3_errors)}

_REPLAY = """
seen as (select e.key, e.event, e.cutoff, p.day, p.value, row_number() over (partition by e.key, e.event order by p.day desc) as k, count(*) over (partition by e.key, e.event) as n from e join p on p.key = e.key and p.day <= e.cutoff),
la as (select key, event, cutoff, day as ld, value as lv, n from seen where k = 1),
ag as (select la.key, la.event, s.value as av, row_number() over (partition by la.key, la.event order by abs(s.day - (ld - 365)), s.day) as k from la join seen s on s.key = la.key and s.event = la.event and abs(s.day - (ld - 365)) <= 60),
pr as (select la.key, la.event, s.value as pv, row_number() over (partition by la.key, la.event order by abs(s.day - (ld - 274)), s.day) as k from la join seen s on s.key = la.key and s.event = la.event and abs(s.day - (ld - 274)) <= 60),
r as (select la.key, la.event, la.cutoff, la.n as observations, pv, (lv - av) / abs(av) as g, lv, coalesce(pv * (1 + (lv - av) / abs(av)), pv, lv * (1 + (lv - av) / abs(av)), lv) as forecast,
  case when pv is not null and av is not null then 'seasonal naive with drift' when pv is not null then 'seasonal naive' when av is not null then 'persistence with drift' else 'persistence' end as method
  from la left join ag on ag.key = la.key and ag.event = la.event and ag.k = 1 left join pr on pr.key = la.key and pr.event = la.event and pr.k = 1)
"""
_E8 = "x8 as (select *, row_number() over (partition by key order by day desc) as k from p), e as (select key, day as event, day - 1 as cutoff from x8 where k <= 8)"
_OUT = f"with {SERIES_SQL}, {_E8}, {_REPLAY}, o as (select r.*, p.value as actual from r join p on p.key = r.key and p.day = r.event)"
_SUM = _OUT + ", y as (select key, abs(forecast - actual) as err, abs(forecast - actual) / abs(actual) as pct from o), z as (select key, count(*) as events, round(median(err), 4) as median_error, round(median(pct), 6) as median_pct, round(avg(pct), 6) as mean_pct, round(min(pct), 6) as min_pct, round(max(pct), 6) as max_pct, round(avg(case when pct <= 0.05 then 1 else 0 end), 4) as within_5pct from y group by 1)"
_SYS = _OUT + ", b as (select key, day as event, lag(value) over (partition by key order by day) as naive, avg(value) over (partition by key order by day rows between 4 preceding and 1 preceding) as drift from p), s3 as (select o.key, o.event, naive, forecast as seasonal, drift from o join b on b.key = o.key and b.event = o.event where naive is not null)"
_ENS = _SYS + """, m as (select key, event, list_sort([struct_pack(v := naive, s := 'naive'), struct_pack(v := seasonal, s := 'seasonal'), struct_pack(v := drift, s := 'drift')]) as m from s3),
q as (select key, event, m[1].v as a, m[2].v as b, m[3].v as c, m[1].s as sa, m[3].s as sc from m),
en as (select key, event, 3 as members, case when c - b > 2 * greatest(b - a, 1e-12) then (a + b) / 2 when b - a > 2 * greatest(c - b, 1e-12) then (b + c) / 2 else b end as value,
 case when c - b > 2 * greatest(b - a, 1e-12) then sc when b - a > 2 * greatest(c - b, 1e-12) then sa end as dropped, (c - a) / abs(b) as spread from q),
ens as (select *, case when spread <= 0.05 then 'tight' when spread <= 0.2 then 'moderate' else 'wide' end as agreement from en)"""
_REC = _SYS + """, w as (select s3.key, s3.event, median(v) as med from (select key, event, unnest([naive, seasonal, drift]) as v from s3) s3 group by 1, 2),
t as (select s3.*, med, 0.6 * 0.4 * case when abs(naive - med) / abs(med) > 0.35 then 0.25 else 1 end as wn, 1.0 * case when abs(seasonal - med) / abs(med) > 0.35 then 0.25 else 1 end as ws, 0.8 * 0.7 * case when abs(drift - med) / abs(med) > 0.35 then 0.25 else 1 end as wd,
 (case when abs(naive - med) / abs(med) > 0.35 then 1 else 0 end + case when abs(seasonal - med) / abs(med) > 0.35 then 1 else 0 end + case when abs(drift - med) / abs(med) > 0.35 then 1 else 0 end) as outliers from s3 join w using (key, event)),
h as (select key, min(value) as lo, max(value) as hi from p group by 1),
u as (select t.*, p.value * 1.02 as an, lo, hi, (naive * wn + seasonal * ws + drift * wd + 1.2 * (p.value * 1.02)) / (wn + ws + wd + 1.2) as mean from t join p on p.key = t.key and p.day = t.event join h on h.key = t.key),
v as (select *, least(greatest(mean, an * 0.95), an * 1.05) as bound from u), c as (select *, least(greatest(bound, lo - (hi - lo)), hi + (hi - lo)) as kept from v)
select key, event, round(kept, 4) as value, cast(outliers as bigint) as outliers, bound <> mean as bounded, kept <> bound as clamped, round(1 - least(abs(greatest(naive, seasonal, drift, an) - med) / abs(med), 1.0), 3) as agreement from c"""
ORACLES = {
    "l2_seasonal_naive": f"with {SERIES_SQL}, e as (select key, max(day) as event, max(day) as cutoff from p group by 1), {_REPLAY} select key, round(forecast, 4) as forecast, method, case when observations >= 8 and pv is not null then 'medium' else 'low' end as confidence, observations from r",
    "l3_blend": _OUT + " select key, event, round(case when abs(actual * 1.3 - forecast) / abs(forecast) > 0.4 then forecast else 0.65 * actual * 1.3 + 0.35 * forecast end, 4) as blended from o",
    "l7_backtest": _OUT + " select key, event, cutoff, round(forecast, 4) as forecast, actual, method from o",
    "g2_backtest_summary": _SUM + " select * from z",
    "g2_overall": _SUM + " select count(*) as series, cast(sum(events) as bigint) as events, round(median(median_pct), 6) as median_of_medians from z",
    "l8_weak": _SUM + " select key, median_pct from z where median_pct > 0.15",
    "l9_score": _OUT + " select key, event, round(least(5.0, abs(forecast - actual) / greatest(abs(actual) * 0.03, greatest(abs(actual) * 0.005, 1e-6))), 6) as score from o",
    "l10_ensemble": _ENS + " select key, event, members, round(value, 4) as value, dropped, round(spread, 6) as spread, agreement from ens",
    "g4_ensemble_summary": _ENS + " select agreement, count(*) as n, count(dropped) as dropped, round(median(spread), 6) as median_spread from ens group by 1",
    "l11_reconcile": _REC,
    "l16_ladder": "with v as (select distinct candidate_id, value, score, currency from value_candidates) select candidate_id, round(case currency when '$' then value when '€' then case when score > 5 then value * 1.5 else value end when '£' then value * 2 else 0 end, 6) as value, case currency when '$' then 'forecast' when '€' then case when score > 5 then 'midpoint' else 'endpoint' end when '£' then 'band' else 'zero' end as source from v",
    "g3_errors": _OUT + " select key, event, round(abs(forecast - actual), 4) as error, round(abs(forecast - actual) / abs(actual), 8) as pct from o",
}
