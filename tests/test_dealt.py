"""The dealt core operators: dirty and empty tables, ties, hot keys, and brute force."""

import datetime as dt
import random

import pyarrow.parquet as pq
import pytest
from helpers import rows
from pyspark.sql import functions as F

from tideline.functions import unit_text as U
from tideline.operators import asof, common, hierarchy, orphans, units

FOUND = {"p2_found": orphans.p2_found, "p4_found": hierarchy.p4_found, "p5_found": asof.p5_found, "p6_found": units.p6_found}
T0 = dt.datetime(2025, 1, 1)
DAY = dt.timedelta(days=1)


@pytest.mark.parametrize("name", sorted(FOUND))
def test_dirty_tables_change_nothing(spark, data, variants, name):
    assert rows(FOUND[name](spark, variants["dirty"])) == rows(FOUND[name](spark, data))


@pytest.mark.parametrize("name", sorted({**orphans.QUERIES, **hierarchy.QUERIES, **asof.QUERIES, **units.QUERIES}))
def test_empty_tables(spark, variants, name):
    q = {**orphans.QUERIES, **hierarchy.QUERIES, **asof.QUERIES, **units.QUERIES}[name]
    assert q(spark, variants["empty"]).collect() == []


def test_orphans_at_the_edges(spark):
    parents = spark.createDataFrame([("A ", T0, None), ("b", T0, T0 + 2 * DAY), ("c", T0 + DAY, T0), ("d", None, None), ("e", T0, T0 + DAY), ("e", T0 + DAY, None)], "key string, loaded_at timestamp, deleted_at timestamp")
    kids = [(1, "a", T0), (2, "B ", T0 + 2 * DAY), (3, "b", T0 + 2 * DAY - dt.timedelta(seconds=1)), (4, "c", T0 + 2 * DAY), (5, "d", T0), (6, " ", T0), (7, None, T0), (8, "zz", T0), (9, "a", None), (10, "a", T0 - DAY), (11, "e", T0 + DAY), (11, "e", T0 + DAY)]
    children = spark.createDataFrame(kids, "id long, ref string, ts timestamp")
    got = sorted(int(r[0]) for r in orphans.orphan_rows(children, "id", "ref", "ts", parents, "key").collect())
    assert got == [2, 4, 5, 8, 9, 10]


@pytest.mark.parametrize("least", [10, 10_000])
def test_orphans_with_a_split_hot_key(spark, monkeypatch, least):
    monkeypatch.setattr(common, "HOT_MIN_ROWS", least)
    parents = spark.createDataFrame([("hot", T0, T0 + 5 * DAY), ("hot", T0 + 7 * DAY, T0 + 8 * DAY), ("cold", T0, None)], "key string, loaded_at timestamp, deleted_at timestamp")
    kids = [(i, "hot" if i % 3 else "cold", T0 + (i % 10) * DAY + (i % 5) * DAY / 7) for i in range(600)]
    children = spark.createDataFrame(kids, "id long, ref string, ts timestamp")
    assert sorted(common.hot_keys(children, "ref", min_rows=least)) == (["cold", "hot"] if least == 10 else [])
    got = {int(r[0]) for r in orphans.orphan_rows(children, "id", "ref", "ts", parents, "key").collect()}
    gone = lambda m: T0 + 5 * DAY <= m < T0 + 7 * DAY or m >= T0 + 8 * DAY
    assert got == {i for i, k, m in kids if k == "hot" and gone(m)} and got


def test_orphan_counts_follow_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write = lambda n, rows_: spark.createDataFrame(rows_, "k string, refs long, exist long").coalesce(1).write.parquet(str(tmp_path / "in" / f"d{n}"))
    counts = orphans.OrphanCounts(spark, str(tmp_path / "state"))
    write(0, [("a", 2, 0), ("b", 1, 1), ("c", 0, 1)])
    for expected in ({("a", 2)}, {("b", 1), ("a", 1)}, {("b", 1)}):
        q = counts.follow(spark.readStream.schema("k string, refs long, exist long").parquet(str(tmp_path / "in" / "*")), str(tmp_path / "check"))
        q.processAllAvailable()
        q.stop()
        assert {tuple(r) for r in counts.current().collect()} == expected
        if expected == {("a", 2)}:
            write(1, [("a", -1, 0), ("b", 0, -1), ("c", 0, -1)])
        else:
            write(2 + len(expected), [("a", -1, 1)] if len(expected) == 2 else [("d", 0, 1)])
    compact = counts.compact(str(tmp_path / "compact"))
    assert {tuple(r) for r in compact.current().collect()} == {("b", 1)}


def walk(parent):
    out = {}
    for x in parent:
        path, y, seen = [x], x, {x}
        while parent[y] is not None:
            y = parent[y]
            if y in seen:
                path = None
                break
            seen.add(y)
            path.append(y)
        out[x] = path and path[::-1]
    return out


@pytest.mark.parametrize("seed,stride", [(1, 8), (2, 3), (3, 10_000)])
def test_hierarchy_against_walking(spark, seed, stride):
    r = random.Random(seed)
    n = 300
    parent = {f"t{i}": (f"t{r.randrange(max(0, i - 3), i)}" if i and r.random() < 0.97 else None) for i in range(n)}
    for i in range(10, n, 60):  # loops of several lengths, one of a single node
        parent[f"t{i}"] = f"t{min(n - 1, i + r.randrange(0, 12))}"
    parent["t5"] = "t5"
    up = spark.createDataFrame([(k, k.upper(), v) for k, v in parent.items()], "id string, name string, up string")
    got = {x["id"]: x["path"] for x in hierarchy.solve(up, stride, paths=True).collect()}
    expected = {k: v and [x.upper() for x in v] for k, v in walk(parent).items()}
    assert got == expected


def test_parent_of_another_run_is_none(spark):
    t = spark.createDataFrame([("a", "r1", None), ("b", "R1 ", "A"), ("c", "r2", "a"), ("d", "r1", "x"), ("d", "r1", "x"), (None, "r1", "a"), ("e", None, "f"), ("f", None, " ")], "task_id string, run_id string, parent_id string")
    got = {x["name"]: x["up"] for x in hierarchy.links(t).collect()}
    assert got == {"a": None, "b": "a", "c": None, "d": None, "e": "f", "f": None}


def brute_asof(events, anchors):
    out = set()
    for i, s, ts in events:
        ok = [(p, c, a) for a, q, p, c in anchors if q == s and s is not None and p and c and ts and p <= ts and c <= ts]
        if ok:
            out.add((i, max(ok)[2]))
    return out


@pytest.mark.parametrize("slot_rows", [200_000, 40])
def test_asof_against_brute_force(spark, slot_rows):
    r = random.Random(7)
    moment = lambda: r.choice([None] + [T0 + r.randrange(200) * DAY / 2 for _ in range(30)])
    series = lambda: r.choice([None, 1, 1, 1, 1, 2, 3])
    anchors = [(i, series(), moment(), moment()) for i in range(150)]
    events = [(i, series(), moment()) for i in range(500)]
    e = spark.createDataFrame(events, "event_id long, series_id long, ts timestamp")
    a = spark.createDataFrame(anchors + anchors[:20], "anchor_id long, series_id long, pub timestamp, cap timestamp")
    got = {(x[0], x[1]) for x in asof.asof_best(e, a, 30, slot_rows).collect()}
    assert got == brute_asof(events, anchors)


def test_published_at_in_every_way(spark):
    from tideline.functions.dates import parse_moment

    ways = {"2024-02-22": "2024-02-22 00:00:00", "20240222": "2024-02-22 00:00:00", "22 Feb 2024": "2024-02-22 00:00:00", "2024-02-22T05:00:00Z": "2024-02-22 05:00:00", "2024-02-22T05:00:00+01:00": "2024-02-22 04:00:00", "2024-02-21T23:00:00-05:00": "2024-02-22 04:00:00", "soon": None, "": None}
    d = spark.createDataFrame([(w,) for w in ways], "w string")
    got = {r[0]: r[1] for r in d.select("w", parse_moment(F.col("w")).cast("string")).collect()}
    assert got == ways


@pytest.mark.parametrize(
    "units_text,family,unit",
    [("USD bn", "money", "money:billion:USD"), ("usdm", "money", "money:million:USD"), ("thousands of EUR", "money", "money:thousand:EUR"), ("GBP '000", "money", "money:thousand:GBP"), ("$000", "money", "money:thousand:USD"), ("single USD", "money", "money:unit:USD"), ("£", "money", "money:unit:GBP"), ("USD (units)", "money", "money:unit:USD"),
     ("BPS", "percent", "percent:hundredth:"), ("per cent", "percent", "percent:unit:"), ("x of 1", "percent", "percent:ratio:"), ("pp", "percent", "percent:unit:"), ("cents / share", "share", "share:hundredth:"), ("¢", "share", "share:hundredth:"), ("GBp", "share", "share:hundredth:GBP"), ("€/share", "share", "share:unit:EUR"), ("p per share", "share", "share:hundredth:GBP"), ("%", "money", None), ("", "money", None), (None, "money", None)],
)
def test_units_fields(units_text, family, unit):
    assert U.of_units(units_text, family) == unit


@pytest.mark.parametrize(
    "text,value,family,unit",
    [("€44.9m of Net sales per the note", 44.9, "money", "money:million:EUR"), ("Net sales was £307 million in the Q2 report", 307.0, "money", "money:million:GBP"), ("Basic EPS 478.6c a share, restated", 478.6, "share", "share:hundredth:"), ("gives Operating margin as (0.0118 as a fraction of one)", -0.0118, "percent", "percent:ratio:"), ("reported Gross margin −514 basis points", -514.0, "percent", "percent:hundredth:"), ("$1,700  thousand of Net sales", 1700.0, "money", "money:thousand:USD"), ("turnover rose to £9m; Net sales $39 mn", 39.0, "money", "money:million:USD"), ("no number", 1.0, "money", None), (None, 1.0, "money", None)],
)
def test_units_near_numbers(text, value, family, unit):
    assert U.near_number(text, value, family) == unit


def test_declared_units():
    assert U.declared("(in thousands of GBP) Baler cash-flow worth 23.5%. | Net sales | 40,000 |", "money") == "money:thousand:GBP"
    assert U.declared("All amounts in USD millions. 25.1% arable. Net sales: 14,429", "money") == "money:million:USD"
    assert U.declared("Net income 50,000 (EUR, thousands)", "money") == "money:thousand:EUR"
    assert U.declared("worth 402 million since $3bn", "money") is None


@pytest.mark.parametrize("text,value,family,unit", [("output of 5,300 t in the year", 5300.0, "mass", "mass:tonne:"), ("a pipe of 12 m and $12 m", 12.0, "length", "length:metre:"), ("a pipe of 12 m", 12.0, "money", "money:million:"), ("sold 7 bbl", 7.0, "mass", None), ("¥5 tn of sales", 5.0, "money", "money:trillion:JPY")])
def test_quantities_and_ambiguous_aliases(text, value, family, unit):
    assert U.near_number(text, value, family) == unit


def test_other_quantities_convert_and_the_rest_is_reported(spark):
    metrics = spark.createDataFrame([("A", "Output", "t", None), ("A", "Net sales", "USDm", "USD")], "ticker string, metric string, units string, currency string")
    none = (None,) * 6
    rows_ = [(1, "a", "output", "d", 5300.0, "kg", *none), (2, "A", "Output", "d", 4.0, "lbs", *none), (3, "A", "Output", "d", 4.0, "EUR", *none), (4, "A", "Net sales", "d", 4.0, "EURm", *none), (5, "A", "Net sales", "d", None, "USDm", *none), (6, "B", "Net sales", "d", 4.0, "USDm", *none), (7, "A", "Net sales", None, 4.0, "USDm", *none)]
    d = spark.createDataFrame(rows_, "id long, ticker string, metric string, doc string, value double, units string, raw string, text string, scale string, currency_mark string, is_percent boolean, is_pence boolean")
    assert {x["id"]: round(x["common_value"], 9) for x in units.convert(d, metrics).collect()} == {1: 5.3, 2: 0.001814369}
    assert {tuple(x) for x in units.unresolved(d, metrics).collect()} == {(3, "no unit"), (4, "other currency"), (5, "no value"), (6, "no such metric"), (7, "no document")}


def test_values_match_as_all_pairs_do(spark, data):
    metrics = common.table(spark, data, "company_metrics")
    c = units.convert(units.candidate_rows(common.table(spark, data, "value_candidates")), metrics).collect()
    e = units.convert(units.evidence_rows(common.table(spark, data, "evidence")), metrics).collect()
    by = {}
    for x in e:
        by.setdefault((x["doc_key"], x["metric_key"]), []).append(x)
    expected = {(a["id"], b["id"]) for a in c for b in by.get((a["doc_key"], a["metric_key"]), []) if abs(a["common_value"] - b["common_value"]) <= 0.0005 * max(abs(a["common_value"]), abs(b["common_value"])) * (1 + 1e-12)}
    assert {tuple(r) for r in units.p6_found(spark, data).collect()} == expected and expected


def test_matching_bands_keep_every_pair(spark):
    r = random.Random(3)
    vals = [0.0, 0.0, -1.0, 1.0, 1.0005, 0.9995, 1.00051, -1.0005, 1e9, 1e9 * 1.0004] + [r.choice([1, -1]) * 10 ** r.uniform(-3, 6) for _ in range(60)]
    vals += [v * (1 + r.uniform(-6e-4, 6e-4)) for v in vals]
    d = spark.createDataFrame([(i, "d", "m", v) for i, v in enumerate(vals)], "id long, doc_key string, metric_key string, common_value double")
    got = {tuple(x) for x in units.matches(d, d).collect()}
    close = lambda a, b: abs(a - b) <= 0.0005 * (1 + 1e-12) * max(abs(a), abs(b))
    assert got == {(i, j) for i, a in enumerate(vals) for j, b in enumerate(vals) if close(a, b)}


def test_every_unit_of_the_tables_is_known(data):
    """No figure with stated units stays unconverted, but for values without any."""
    for t, col, text in (("evidence", "units", "claim"), ("value_candidates", "units", "raw")):
        rows_ = pq.read_table(f"{data}/{t}.parquet", columns=["metric", col, text, "value"]).to_pylist()
        for x in rows_:
            if x[col] and x[col].strip() and x["value"] is not None:
                family = "percent" if "margin" in x["metric"].lower() or "Comparable" in x["metric"] else "share" if "EPS" in x["metric"] else "money"
                assert U.of_units(x[col], family), x
