"""Joins, merges, set operations and grouping with their tie rules, on the star-schema tables and the run tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import norm_key, table


def first_per_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in a stated order; an order that does not tell rows apart must not be given."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def union_first(parts: list[DataFrame], key: list[str], order: list) -> DataFrame:
    """All parts' rows, of each key the one from the earliest part."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    whole = tagged[0]
    for t in tagged[1:]:
        whole = whole.unionByName(t)
    return first_per_key(whole, key, [F.col("_part"), *order]).drop("_part")


def merge_attempts(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Per key the attempt (value, errors) with fewer errors, the first of equals; keys of either side."""
    a = first.select(key, F.struct("value", "errors").alias("a"))
    b = second.select(key, F.struct("value", "errors").alias("b"))
    j = a.join(b, key, "full")
    use_b = F.col("a").isNull() | (F.col("b").isNotNull() & (F.col("b.errors") < F.col("a.errors")))
    return j.select(key, F.when(use_b, F.col("b.value")).otherwise(F.col("a.value")).alias("value"), F.when(use_b, "second").otherwise("first").alias("kept"))


def upper_median(column: str) -> Column:
    """The upper of the middle values; equal values are counted before they are shuffled."""
    return F.expr(f"percentile_disc(0.5) within group (order by {column} desc)")


def coalesce_outer(first: DataFrame, second: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Full outer join on key; each field from the first side that has it."""
    b = second.select(*key, *[F.col(f).alias(f"_{f}") for f in fields])
    return first.select(*key, *fields).join(b, key, "full").select(*key, *[F.coalesce(f, f"_{f}").alias(f) for f in fields])


def norm_label(c: Column) -> Column:
    """A label as it is compared: letters and digits only, lower case."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two labels as twice the matching characters over both lengths, in matching blocks."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def fuzzy_labels(labels: DataFrame, known: DataFrame, least: float = 0.72) -> DataFrame:
    """(label, match, ratio): the known label of each label, by normal form or else by the best ratio from `least` on.

    known is a dimension table; it is broadcast only when counted small, and each distinct label is compared once.
    """
    from .common import MAX_BROADCAST_ROWS

    k = known.select(F.col("label").alias("match"), norm_label(F.col("label")).alias("nk")).distinct()
    d = labels.select("label").where("label is not null").distinct().withColumn("n", norm_label(F.col("label")))
    exact = d.join(k, F.col("n") == F.col("nk")).groupBy("label").agg(F.min("match").alias("match")).withColumn("ratio", F.lit(1.0))
    rest = d.join(exact.select("label"), "label", "left_anti")
    if k.count() > MAX_BROADCAST_ROWS:
        raise ValueError("known labels are a dimension table")
    near = rest.join(F.broadcast(k)).withColumn("ratio", sequence_ratio(F.lower("label"), F.lower("match"))).where(F.col("ratio") >= least)
    best = near.groupBy("label").agg(F.max(F.struct("ratio", "match")).alias("s")).select("label", "s.match", "s.ratio")
    return exact.unionByName(best)


def safe_eval(expr: str) -> float | None:
    """The value of a closed arithmetic expression of + - * / % ** and brackets; None for anything else."""
    import ast
    import operator as op

    two = {ast.Add: op.add, ast.Sub: op.sub, ast.Mult: op.mul, ast.Div: op.truediv, ast.Pow: op.pow, ast.Mod: op.mod}
    one = {ast.UAdd: op.pos, ast.USub: op.neg}

    def value(n: ast.AST) -> float:
        match n:
            case ast.Expression(body=b):
                return value(b)
            case ast.Constant(value=v) if type(v) in (int, float):
                return v
            case ast.BinOp(left=a, op=o, right=b) if type(o) in two:
                x, y = value(a), value(b)
                if isinstance(o, ast.Pow) and (abs(y) > 64 or abs(x) > 1e9):
                    raise ValueError("power out of range")
                return two[type(o)](x, y)
            case ast.UnaryOp(op=o, operand=a) if type(o) in one:
                return one[type(o)](value(a))
        raise ValueError("not arithmetic")

    try:
        out = value(ast.parse(expr, mode="eval"))
        return float(out) if isinstance(out, (int, float)) else None
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, RecursionError, TypeError, MemoryError):
        return None


def arithmetic_claims(df: DataFrame, column: str, tolerance: float = 0.01) -> DataFrame:
    """df with `claims`: array of (expression, stated, computed, ok) for every `expression = number` in a text column."""
    import re

    claim = re.compile(r"([-+(]?[\d(][\d\s.,()+\-*/x×%$£€]*[\d)%])\s*=\s*[$£€]?\s*(-?\d[\d,]*(?:\.\d+)?)\s*(%)?")

    def check(text: str | None) -> list[tuple]:
        out = []
        for m in claim.finditer(text or ""):
            plain = re.sub(r"(\d(?:[\d.]*\d)?)\s*%", r"(\1/100)", re.sub(r"[$£€,]", "", m[1])).replace("×", "*").replace("x", "*")
            got, said = safe_eval(plain.strip()), float(m[2].replace(",", ""))
            if not re.search(r"[-+*/]", plain.strip().lstrip("-+")):
                continue
            ok = got is not None and any(abs(got * f - said) <= tolerance * max(abs(said), 1e-9) for f in (1, 100))
            out.append((m[1].strip(), said, got, ok))
        return out

    @F.pandas_udf("array<struct<expression:string,stated:double,computed:double,ok:boolean>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: [dict(zip(("expression", "stated", "computed", "ok"), c, strict=True)) for c in check(t)])

    return df.withColumn("claims", run(F.col(column)))


def misses_value(claims: Column, value: Column, tolerance: float = 0.01) -> Column:
    """Whether sums of the scale of a value were stated and none of them comes to it."""
    lands = F.transform(claims, lambda c: F.when(c["ok"] & (F.abs(c["computed"] * 100 - c["stated"]) <= tolerance * F.greatest(F.abs(c["stated"]), F.lit(1e-9))), c["computed"] * 100).otherwise(c["stated"]))
    near = F.filter(lands, lambda x: (F.abs(x) / F.abs(value)).between(0.5, 2.0))
    return (F.abs(value) > 1e-9) & (F.size(near) > 0) & ~F.exists(near, lambda x: F.abs(x - value) / F.abs(value) <= tolerance)


def e12_landings(spark, sf_dir):
    """Whether made derivations come to the value that they are for."""
    a = table(spark, sf_dir, "value_candidates").select("candidate_id", "value").distinct().where("value is not null and value > 0.01")
    made = F.concat(F.lit("1 + 1 = 2; then "), F.format_string("%.4f", "value"), F.lit(" * 1 = "), F.format_string("%.4f", F.col("value") * F.when(F.col("candidate_id") % 3 == 0, 1.2).otherwise(1.0)))
    return arithmetic_claims(a.withColumn("text", made), "text").select("candidate_id", misses_value(F.col("claims"), F.col("value")).alias("misses"))


def f1_lookup(spark, sf_dir):
    """Order totals by nation through two dimension lookups."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.select(F.col("o_custkey").alias("c_custkey"), "o_totalprice").join(c.select("c_custkey", "c_nationkey"), "c_custkey").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # nation has 25 rows
    return j.groupBy("n_name").agg(F.count("*").alias("orders"), (F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 100.0).alias("total"))


def f2_semi(spark, sf_dir):
    """Customers with an urgent order."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("customers"))


def f3_anti(spark, sf_dir):
    """Evidence for whose document and metric there is no candidate."""
    e = table(spark, sf_dir, "evidence").select("evidence_id", norm_key("source").alias("k"), "metric").where("k is not null").distinct()
    d = table(spark, sf_dir, "value_candidates").select(norm_key("source_path").alias("k"), "metric")
    return e.join(d, ["k", "metric"], "left_anti").select("evidence_id")


def f4_pivot(spark, sf_dir):
    """Anchors, candidates and evidence per metric, side by side."""
    parts = [table(spark, sf_dir, t).select("metric", F.lit(n).alias("source"), F.col(k).alias("id")) for t, n, k in (("guidance_anchors", "anchors", "anchor_id"), ("value_candidates", "candidates", "candidate_id"), ("evidence", "evidence", "evidence_id"))]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()
    return u.groupBy("metric").pivot("source", ["anchors", "candidates", "evidence"]).count()


def f9_theta(spark, sf_dir):
    """Metrics matched to families by the words in them, the first family of equals."""
    families = spark.createDataFrame([(1, "eps", "share"), (2, "margin", "percent"), (3, "sales", "money"), (4, "revenue", "money"), (5, "fees", "money"), (6, "income", "money")], "ord int, needle string, family string")
    m = table(spark, sf_dir, "company_metrics").select("metric").distinct()
    j = m.join(F.broadcast(families), F.contains(F.lower("metric"), F.col("needle")))
    return j.groupBy("metric").agg(F.min(F.struct("ord", "needle", "family")).alias("s")).select("metric", "s.needle", "s.family")


def f10_fuzzy(spark, sf_dir):
    """Written variants of metric labels matched to the known ones."""
    known = table(spark, sf_dir, "company_metrics").select(F.col("metric").alias("label")).distinct()
    forms = known.select(F.explode(F.array(F.upper("label"), F.concat(F.lit("Total "), F.lower("label")), F.regexp_replace("label", "[aeiou]([a-z])$", "$1"), F.reverse("label"))).alias("label"))
    return fuzzy_labels(forms, known).select("label", "match", F.round("ratio", 6).alias("ratio"))


def f14_merge(spark, sf_dir):
    """Two versions of a task's outcome: the one with fewer errors."""
    t = table(spark, sf_dir, "tasks").groupBy("task_id").agg(F.min(F.struct("loaded_at", "status")).alias("a"), F.max(F.struct("loaded_at", "status")).alias("b"), F.count("*").alias("n"))
    errors = lambda c: F.when(F.col(c) == "completed", 0).when(F.col(c) == "running", 1).otherwise(2)
    first = t.select("task_id", F.col("a.status").alias("value"), errors("a.status").alias("errors"))
    second = t.where("n > 1").select("task_id", F.col("b.status").alias("value"), errors("b.status").alias("errors"))
    return merge_attempts(first, second, "task_id")


def f15_coalesce(spark, sf_dir):
    """Per day: sales from clicks, else from views, and from either side what the other lacks."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    total = (F.sum(F.round(F.col("value") * 10000).cast("long")) / 10000.0).alias("total")
    a = e.where("event_type = 'purchase'").groupBy("day", "user_id").agg(total, F.lit(None).cast("long").alias("n"))
    b = e.where("event_type = 'signup'").groupBy("day", "user_id").agg(total, F.count("*").alias("n"))
    return coalesce_outer(a, b, ["day", "user_id"], ["total", "n"])


def e12_arithmetic(spark, sf_dir):
    a = table(spark, sf_dir, "value_candidates").select("candidate_id", "value").distinct()
    made = F.concat(F.lit("so "), F.round("value", 2), F.lit(" * 2 = "), F.round(F.col("value") * F.when(F.col("candidate_id") % 3 == 0, 2.5).otherwise(2.0), 2), F.lit(" and 10% of 50 = five, 40 × 1.5 = 60"))
    return arithmetic_claims(a.where("value > 1 and value < 100000").select("candidate_id", made.alias("text")), "text").select("candidate_id", F.inline("claims"))


def g1_group_count(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("published_at is not null")
    return d.groupBy("company_slug", F.date_format("published_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("documents"))


def g9_cost(spark, sf_dir):
    """Tokens, requests and cost per model, versions of a task counted once."""
    t = first_per_key(table(spark, sf_dir, "tasks"), ["task_id"], [F.desc("loaded_at"), F.desc_nulls_last("status")])
    s = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return t.groupBy("model").agg(F.count("*").alias("tasks"), s("prompt_tokens").alias("prompt"), s("cached_tokens").alias("cached"), s("completion_tokens").alias("completion"), s("requests").alias("requests"), (F.sum(F.round(F.coalesce("cost_usd", F.lit(0.0)) * 10000).cast("long")) / 10000.0).alias("cost"))


def g12_upper_median(spark, sf_dir):
    """The upper of the middle values, and how many are above zero, per metric."""
    v = table(spark, sf_dir, "value_candidates").select("candidate_id", "metric", "value").distinct()
    return v.groupBy("metric").agg(upper_median("value").alias("upper_median"), F.count_if(F.col("value") > 0).alias("above"))


def g20_keep_first(spark, sf_dir):
    """The first evidence row of each source and metric."""
    e = table(spark, sf_dir, "evidence").select("evidence_id", "source", "metric", "ts").distinct()
    return first_per_key(e, ["source", "metric"], ["ts", "evidence_id"]).select("source", "metric", "evidence_id")


def g21_pivot_lines(spark, sf_dir):
    """Quarters with each order status as a column, the rarer two merged, quarters without any left out."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    q = F.date_format(F.trunc(F.col("o_orderdate").cast("date"), "quarter"), "yyyy-MM")
    p = o.groupBy(q.alias("quarter")).pivot("o_orderstatus", ["O", "P"]).count()
    return p.select("quarter", F.coalesce("P", "O").alias("preferred"), "O", "P").where("preferred is not null")


def g22_evidence(spark, sf_dir):
    e = table(spark, sf_dir, "evidence").select("evidence_id", F.upper(F.element_at(F.split("ticker", ":"), -1)).alias("ticker"), "metric", "source").distinct()
    return e.groupBy("ticker", "metric").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


def h1_cap(spark, sf_dir):
    """The three dearest orders of each customer."""
    o = table(spark, sf_dir, "orders")
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return o.withColumn("k", k).where("k <= 3").select("o_custkey", "o_orderkey", "k")


def h7_islands(spark, sf_dir):
    """Runs of consecutive days on which a user was active."""
    d = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    i = F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    return d.withColumn("i", i).groupBy("user_id", "i").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("days")).drop("i")


def i2_composite_sort(spark, sf_dir):
    """The newest and dearest twenty orders."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return o.orderBy(F.desc("o_orderdate"), F.desc("o_totalprice"), "o_orderkey").limit(20)


def i5_severity(spark, sf_dir):
    """The worst twenty tasks, errors first, in order of start."""
    t = table(spark, sf_dir, "tasks").select("task_id", "status", "started_at").distinct()
    rank = F.when(F.col("status") == "failed", 0).when(F.col("status") == "running", 1).otherwise(2)
    return t.orderBy(rank, "started_at", "task_id", "status").limit(20).select("task_id", "status")


def j1_union(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"))
    b = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"))
    return a.unionByName(b).groupBy("kind", "nation").agg(F.count("*").alias("n"))


def j2_union_first(spark, sf_dir):
    """One value per source and metric: a candidate's if there is one, else the evidence's."""
    c = table(spark, sf_dir, "value_candidates").select(F.col("source_path").alias("source"), "metric", F.col("candidate_id").alias("id")).distinct()
    e = table(spark, sf_dir, "evidence").where("source is not null").select("source", "metric", F.col("evidence_id").alias("id")).distinct()
    return union_first([c, e], ["source", "metric"], ["id"])


def j3_except(spark, sf_dir):
    """Customers without an urgent order."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").subtract(urgent)


def j4_intersect(spark, sf_dir):
    """Nations with both customers and suppliers."""
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")))


def k_json_replies(spark, sf_dir):
    """Candidates written as replies, fenced, in prose and broken, read and held against a schema."""
    from ..functions.replies import json_text, schema_problem

    c = table(spark, sf_dir, "value_candidates").select("candidate_id", "value").distinct()
    body = F.concat(F.lit('{"id": '), F.col("candidate_id"), F.when(F.col("candidate_id") % 3 == 0, F.lit("}")).otherwise(F.lit(', "unit": "m"}')))
    made = F.when(F.col("candidate_id") % 5 == 0, "no reply").when(F.col("candidate_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Here it is: "), body, F.lit(" as asked")))
    t = json_text(made)
    schema = {"type": "object", "required": ["id", "unit"], "properties": {"id": {"type": "number"}, "unit": {"type": "string"}}}
    return c.select("candidate_id", F.get_json_object(t, "$.id").alias("id"), schema_problem(t, schema).alias("problem"))


def k_json_props(spark, sf_dir):
    e = table(spark, sf_dir, "run_events").select("event_id", "payload").distinct()
    p = F.from_json("payload", "n int, chars int")
    return e.select("event_id", p["n"].alias("n"), p["chars"].alias("chars"))


def k_sha_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2(F.concat_ws("|", "rel_path", "text"), 256).alias("cache_key"))


def k_slug(spark, sf_dir):
    from ..functions.text import slugify

    return table(spark, sf_dir, "documents").select("doc_id", slugify(F.col("title")).alias("slug"))


QUERIES = {f.__name__: f for f in (
    f1_lookup, f2_semi, f3_anti, f4_pivot, f9_theta, f10_fuzzy, f14_merge, f15_coalesce, e12_arithmetic, g1_group_count, g9_cost, g12_upper_median, g20_keep_first, g21_pivot_lines,
    g22_evidence, h1_cap, h7_islands, i2_composite_sort, i5_severity, j1_union, j2_union_first, j3_except, j4_intersect, k_json_props, k_sha_key, k_slug, e12_landings, k_json_replies)}
_SP = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160)"
ORACLES = {
    "e12_landings": "select distinct candidate_id, candidate_id % 3 = 0 and not (value between 1.0 and 4.0 and abs(2 - value) / value <= 0.01) as misses from value_candidates where value > 0.01",
    "k_json_replies": "select distinct candidate_id, case when candidate_id % 5 <> 0 then cast(candidate_id as varchar) end as id, case when candidate_id % 5 = 0 then 'no JSON' when candidate_id % 3 = 0 then '/unit: missing' end as problem from value_candidates",
    "f1_lookup": "select n_name, count(*) as orders, sum(cast(round(o_totalprice * 100) as bigint)) / 100.0 as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1",
    "f2_semi": "select c_mktsegment, count(*) as customers from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT') group by 1",
    "f3_anti": f"select distinct evidence_id from evidence where nullif(lower(trim(source, {_SP})), '') is not null and not exists (select 1 from value_candidates v where lower(trim(v.source_path, {_SP})) = lower(trim(evidence.source, {_SP})) and v.metric = evidence.metric)",
    "f4_pivot": "select metric, nullif(count(distinct id) filter (s = 'a'), 0) as anchors, nullif(count(distinct id) filter (s = 'c'), 0) as candidates, nullif(count(distinct id) filter (s = 'e'), 0) as evidence from (select metric, 'a' as s, anchor_id as id from guidance_anchors union all select metric, 'c', candidate_id from value_candidates union all select metric, 'e', evidence_id from evidence) group by 1",
    "f9_theta": "with f as (select * from (values (1, 'eps', 'share'), (2, 'margin', 'percent'), (3, 'sales', 'money'), (4, 'revenue', 'money'), (5, 'fees', 'money'), (6, 'income', 'money')) t(ord, needle, family)), j as (select metric, needle, family, row_number() over (partition by metric order by ord) as k from (select distinct metric from company_metrics) join f on contains(lower(metric), needle)) select metric, needle, family from j where k = 1",
    "f14_merge": "with t as (select task_id, status, row_number() over (partition by task_id order by loaded_at, status) as a, row_number() over (partition by task_id order by loaded_at desc, status desc) as b, count(*) over (partition by task_id) as n from tasks), f as (select task_id, max(case when a = 1 then status end) as s1, max(case when b = 1 and n > 1 then status end) as s2 from t group by 1), g as (select *, case s1 when 'completed' then 0 when 'running' then 1 else 2 end as e1, case s2 when 'completed' then 0 when 'running' then 1 else 2 end as e2 from f) select task_id, case when s2 is not null and e2 < e1 then s2 else s1 end as value, case when s2 is not null and e2 < e1 then 'second' else 'first' end as kept from g",
    "f15_coalesce": "with a as (select cast(ts as date) as day, user_id, sum(cast(round(value * 10000) as bigint)) / 10000.0 as total from events where event_type = 'purchase' group by 1, 2), b as (select cast(ts as date) as day, user_id, sum(cast(round(value * 10000) as bigint)) / 10000.0 as total, count(*) as n from events where event_type = 'signup' group by 1, 2) select coalesce(a.day, b.day) as day, coalesce(a.user_id, b.user_id) as user_id, coalesce(a.total, b.total) as total, b.n from a full join b on a.day = b.day and a.user_id = b.user_id",
    "g1_group_count": "select company_slug, strftime(published_at, '%Y-%m') as month, count(*) as documents from documents where published_at is not null group by 1, 2",
    "g9_cost": "with t as (select *, row_number() over (partition by task_id order by loaded_at desc, status desc nulls last) as k from tasks) select model, count(*) as tasks, cast(sum(coalesce(prompt_tokens, 0)) as bigint) as prompt, cast(sum(coalesce(cached_tokens, 0)) as bigint) as cached, cast(sum(coalesce(completion_tokens, 0)) as bigint) as completion, cast(sum(coalesce(requests, 0)) as bigint) as requests, sum(cast(round(coalesce(cost_usd, 0.0) * 10000) as bigint)) / 10000.0 as cost from t where k = 1 group by 1",
    "g12_upper_median": "with v as (select distinct candidate_id, metric, value from value_candidates), r as (select metric, value, row_number() over (partition by metric order by value) as k, count(*) over (partition by metric) as n from v) select metric, max(case when k = n // 2 + 1 then value end) as upper_median, count(*) filter (value > 0) as above from r group by 1",
    "g20_keep_first": "select source, metric, evidence_id from (select source, metric, evidence_id, row_number() over (partition by source, metric order by ts, evidence_id) as k from (select distinct evidence_id, source, metric, ts from evidence)) where k = 1",
    "g21_pivot_lines": "with g as (select strftime(date_trunc('quarter', o_orderdate), '%Y-%m') as quarter, nullif(count(*) filter (o_orderstatus = 'O'), 0) as \"O\", nullif(count(*) filter (o_orderstatus = 'P'), 0) as \"P\" from orders where o_orderstatus <> 'F' group by 1) select quarter, coalesce(\"P\", \"O\") as preferred, \"O\", \"P\" from g where coalesce(\"P\", \"O\") is not null",
    "g22_evidence": "select ticker, metric, count(*) as n, count(distinct source) as sources from (select distinct evidence_id, upper(split_part(ticker, ':', -1)) as ticker, metric, source from evidence) group by 1, 2",
    "h1_cap": "select o_custkey, o_orderkey, cast(k as integer) as k from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as k from orders) where k <= 3",
    "h7_islands": "with d as (select distinct user_id, cast(ts as date) as day from events), i as (select *, day - cast(row_number() over (partition by user_id order by day) as integer) as i from d) select user_id, min(day) as first, max(day) as last, count(*) as days from i group by user_id, i",
    "i2_composite_sort": "select o_orderkey, o_orderdate, o_totalprice from orders order by o_orderdate desc, o_totalprice desc, o_orderkey limit 20",
    "i5_severity": "select task_id, status from (select distinct task_id, status, started_at from tasks) order by case status when 'failed' then 0 when 'running' then 1 else 2 end, started_at, task_id, status limit 20",
    "j1_union": "select 'customer' as kind, c_nationkey as nation, count(*) as n from customer group by 2 union all select 'supplier', s_nationkey, count(*) from supplier group by 2",
    "j2_union_first": "with u as (select source_path as source, metric, candidate_id as id, 0 as p from value_candidates union select source, metric, evidence_id, 1 from evidence where source is not null) select source, metric, id from (select *, row_number() over (partition by source, metric order by p, id) as k from u) where k = 1",
    "j3_except": "select c_custkey from customer except select o_custkey from orders where o_orderpriority = '1-URGENT'",
    "j4_intersect": "select c_nationkey as nation from customer intersect select s_nationkey from supplier",
    "k_json_props": "select distinct event_id, cast(json_extract(payload, '$.n') as integer) as n, cast(json_extract(payload, '$.chars') as integer) as chars from run_events",
    "k_sha_key": "select doc_id, sha256(concat_ws('|', rel_path, text)) as cache_key from documents where text is not null",
    "k_slug": "select doc_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') as slug from documents",
}
