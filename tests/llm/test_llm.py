"""The text corpus operators: oracle, dirty and empty tables, brute force, round trips and held-out accuracy."""

import itertools
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from helpers import oracle_rows, rows
from pyspark.sql import functions as F

from tideline.llm import lines, mixing, near_duplicates, packing, registry, shingles, splitting, subjects, tokens

WORDS = re.compile(r"[^\W_]+")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, data, name):
    cols, got = rows(registry.QUERIES[name](spark, data))
    assert got == oracle_rows(duck, registry.ORACLES[name], cols)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, variants, name):
    got = registry.QUERIES[name](spark, variants["empty"])
    if name in ("p8_summary",):
        assert got.collect()[0]["containers"] == 0
    elif name == "p10_thresholds":
        assert got.count() == 0
    elif name == "p9_shares":
        assert all(r["tokens"] == 0 for r in got.collect())
    else:
        assert got.collect() == []


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p3_pieces", "p7_found", "p7_classes", "p8_containers", "p9_mixed"])
def test_dirty_tables_change_nothing(spark, data, variants, name):
    assert rows(registry.QUERIES[name](spark, variants["dirty"])) == rows(registry.QUERIES[name](spark, data))


def test_subjects_of_dirty_tables(spark, data, variants):
    assert subjects.p10_found(spark, variants["dirty"]).count() == subjects.p10_found(spark, data).count()


# repeated lines


def brute_lines(docs, min_docs, share):
    norm = lambda x: " ".join(x.split()).lower()
    by, size = {}, {}
    for i, company, text in docs:
        if company is None:
            continue
        c = norm(company)
        size[c] = size.get(c, 0) + 1
        for x in {norm(y) for y in (text or "").split("\n")} - {""}:
            by.setdefault((c, x), set()).add(i)
    found = {k for k, v in by.items() if len(v) >= min_docs and len(v) >= share * size[k[0]]}
    return {(i, n + 1) for i, company, text in docs if company is not None for n, y in enumerate((text or "").split("\n")) if (norm(company), norm(y)) in found}


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_against_counting(spark, seed):
    r = random.Random(seed)
    notices = ["All rights  reserved", "share this page", "By the NEWS desk\r", "", "  "]
    docs = []
    for i in range(120):
        body = [r.choice([*notices, f"own line {i} {j}", "half seen"]) for j in range(r.randrange(0, 12))]
        docs.append((i, r.choice(["Acme", " acme ", "ACME  ", "Bolt Co", "bolt  co", None]), r.choice([None, "", "\n".join(body), "\n".join(body), "\n".join(body)])))
    d = spark.createDataFrame(docs, "doc_id long, company string, text string")
    got = {tuple(x) for x in lines.repeated_lines(d).collect()}
    assert got == brute_lines(docs, 5, 0.2) and got


def test_blocks_of_several_lines(spark):
    docs = [(i, "a", "first\n\nsecond\nthird\n" + f"own {i}\nsecond") for i in range(8)]
    d = spark.createDataFrame(docs, "doc_id long, company string, text string")
    got = sorted((len(b["block"]), b["docs"]) for b in lines.blocks(d).collect())
    assert got == [(1, 8), (1, 8), (1, 8), (2, 8), (2, 8), (3, 8)]


def test_blocks_count_documents_and_decide(spark):
    """Three documents hold a block twice each, six occurrences; the intervals' documents keep it from being deleted."""
    docs = [(i, "a", f"one\ntwo\nown {i}\none\ntwo\nx {i}\nall" if i < 3 else f"all\nmine {i}") for i in range(10)]
    d = spark.createDataFrame(docs, "doc_id long, company string, text string")
    kept = lines.often(lines.line_table(d))
    assert kept.count() == 3  # the bound alone lets the lines of the block pass
    assert [(len(b["block"]), b["docs"]) for b in lines.blocks(d).collect()] == [(1, 10)]
    assert {tuple(x) for x in lines.repeated_lines(d).collect()} == {(i, 7 if i < 3 else 1) for i in range(10)}


@pytest.mark.parametrize("seed", [1, 2])
def test_weights_count_documents(spark, seed):
    r = random.Random(seed)
    docs = [(i, "a", "\n".join(r.choice("abc") for _ in range(r.randrange(0, 9)))) for i in range(30)]
    d = spark.createDataFrame(docs, "doc_id long, company string, text string")
    t = lines.line_table(d)
    name = {x["h"]: x["x"] for x in spark.createDataFrame([(c,) for c in "abc"], "x string").select("x", F.xxhash64("x").alias("h")).collect()}
    got = {"".join(name[h] for h in b["block"]): b["docs"] for b in lines.blocks(d, min_docs=2, min_share=0.0).collect()}
    texts = [x.replace("\n", "") for _, _, x in docs]
    count = {x[i:j]: 0 for x in texts for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
    for k in count:
        count[k] = sum(k in x for x in texts)
    assert t.count() == 30 and got == {k: n for k, n in count.items() if n >= 2}


def test_lines_of_blocks_longer_than_a_suffix(spark):
    docs = [(i, "a", "\n".join(f"line {k}" for k in range(80))) for i in range(6)]
    d = spark.createDataFrame(docs, "doc_id long, company string, text string")
    assert lines.repeated_lines(d).count() == 480


# splitting


def test_pieces_rebuild_the_text(spark):
    r = random.Random(5)
    texts = ["x" * 20_000, "é" * 6_001, "word " * 5_000, "a\r\n\r\nb. c d! " * 2_000, "\n" * 7_000, " " * 6_500, "日本語。" * 4_000, "".join(r.choice("ab é\n.日  ") for _ in range(150_000))]
    d = spark.createDataFrame(list(enumerate(texts)) + [(90, None), (91, ""), (92, "y" * 6_000), (0, texts[0])], "doc_id long, text string")
    got = {}
    for x in splitting.split_texts(d).orderBy("doc_id", "piece_no").collect():
        got.setdefault(x["doc_id"], []).append(x)
    assert sorted(got) == list(range(len(texts)))
    for i, pieces in got.items():
        assert [p["piece_no"] for p in pieces] == list(range(1, len(pieces) + 1))
        assert pieces[0]["start"] == 0 and pieces[-1]["end"] == len(texts[i])
        for p in pieces:
            assert p["text"] == texts[i][p["start"] : p["end"]] and len(p["text"]) <= splitting.LIMIT
        for p, q in itertools.pairwise(pieces):
            assert q["start"] <= p["end"] and p["end"] - q["start"] <= splitting.OVERLAP and p["end"] > p["start"] < q["end"]
    ends = [x for x in got[2][:-1]]
    assert all(texts[2][p["end"] - 1] == " " for p in ends)


def test_pieces_do_not_depend_on_ranges(spark):
    r = random.Random(1)
    texts = [
        "".join(r.choice(["Word. ", "é", "\n\n", "日本 ", "x\r\n", " ", "\u00a0", "a\u00a0\u00a0b"]) for _ in range(9_000)),
        "First paragraph. " * 300 + " " * 3_000 + "\n" + "\u00a0" * 700 + "\n" + " " * 900 + "And so on, " * 1_500,
        " \n" * 5_000 + "x" * 9_000 + "\n\n", "é" * 13_000, "\u00a0" * 7_000, "ab " * 5_000,
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [sorted(map(tuple, splitting.offsets(splitting.ranges_of_texts(d, "doc_id", n)).collect())) for n in (7, 1_000, 4_096, 65_536, 10_000_000)]
    assert {x[0] for x in found[0]} == set(range(len(texts))) and all(f == found[0] for f in found)


def test_a_window_far_into_a_file():
    """Places beyond 32 bits; only a window of the boundaries is held."""
    c = splitting.Cutter()
    c.chars = c.start = c.bytes = c.start_byte = 3 << 31
    line = b"Some words of a line.\n" * 40
    for _ in range(30):
        about, at, byte, kind = splitting.boundaries(line, 0, len(line), c.chars)
        for p in c.feed(about | {"lead_chars": 0}, len(line), at, byte, kind):
            assert p[2] - p[1] <= splitting.LIMIT and p[1] == p[3] >= 3 << 31 and (p[2] - (3 << 31)) % 22 == 0
    assert c.pieces == 4 and len(c.at) < 2_000 and c.finish()[-1][2] == (3 << 31) + 30 * len(line)


def test_files_are_split_like_texts(spark, tmp_path):
    r = random.Random(2)
    text = "".join(r.choice(["Some words. ", "é ", "\n\n", "line\n", "\u00a0"]) for _ in range(40_000))
    (tmp_path / "a.txt").write_text(text, encoding="utf-8", newline="")
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    own = [tuple(x)[1:] for x in splitting.split_texts(d).orderBy("piece_no").collect()]
    for n in (5_000, splitting.FILE_RANGE_BYTES):
        assert [tuple(x)[1:] for x in splitting.split_files(spark, [str(tmp_path / "a.txt")], n).orderBy("piece_no").collect()] == own


# near-duplicates


def brute_pairs(texts, num=3, den=5):
    sets = {}
    for i, t in texts.items():
        w = WORDS.findall((t or "").lower())
        if s := set(zip(w, w[1:], w[2:], strict=False)):
            sets[i] = s
    out = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common * den >= (len(sets[a]) + len(sets[b]) - common) * num:
            out.add((a, b))
    return out, set(sets)


def edited(r, base):
    w = base.split()
    for _ in range(r.randrange(0, len(w) // 6 + 1)):
        k = r.randrange(len(w))
        w[k : k + r.randrange(0, 2)] = r.choice([[], ["new"], [f"n{r.randrange(99)}"]])
    return " ".join(w)


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_against_all_pairs(spark, seed):
    r = random.Random(seed)
    texts = {0: None, 1: "", 2: "two words", 3: "one two three", 4: "One, two - three!", 5: "É é ü 3 x", 6: "é É Ü 3 X"}
    for g in range(40):
        base = " ".join(f"w{r.randrange(120)}" for _ in range(r.choice([5, 20, 80, 300])))
        for _ in range(r.choice([1, 2, 5])):
            texts[len(texts)] = edited(r, base)
    expected, with_set = brute_pairs(texts)
    d = spark.createDataFrame([(0, i, t) for i, t in texts.items() if t is not None], "tag int, id long, text string")
    similar, members = near_duplicates.similar_sets(d)
    fp = {x["id"]: x["fp"] for x in members.collect()}
    pairs = {frozenset((x["fa"], x["fb"])) for x in similar.collect()}
    got = {(a, b) for a, b in itertools.combinations(sorted(fp), 2) if fp[a] == fp[b] or frozenset((fp[a], fp[b])) in pairs}
    assert set(fp) == with_set and got == expected and expected


def test_triples_of_hashes_are_those_of_words():
    texts = ["A b c d", "a  B, c\nd e", "_x_ y1 2z", "ß İ ǅ a", "", "one two"]
    doc, h = shingles.triples(texts, [0] * len(texts))
    for i, t in enumerate(texts):
        w = WORDS.findall(t.lower())
        assert (doc == i).sum() == len(set(zip(w, w[1:], w[2:], strict=False)))
    assert set(h[doc == 0]) <= set(h[doc == 1])
    assert not set(h[doc == 0]) & set(shingles.triples(["A b c d"], [1])[1])


@pytest.mark.parametrize(("num", "den"), [(3, 5), (4, 5)])
def test_similar_sets_share_enough_keys(num, den):
    """The bound on shared neighbours, and on those left after each text has left out its most common ones."""
    r = random.Random(num)
    checked = 0
    for _ in range(4000):
        a = set(r.sample(range(40), r.randrange(1, 30)))
        b = set(r.sample(sorted(a), max(1, int(len(a) * r.uniform(0.6, 1))))) | set(r.sample(range(40), r.randrange(0, 6)))
        common, s = len(a & b), len(a) + len(b)
        if a == b or common * den < (s - common) * num:
            continue
        checked += 1
        keys = [set(zip([-1, *sorted(x)], [*sorted(x), 99], strict=True)) for x in (a, b)]
        shared = keys[0] & keys[1]
        assert len(shared) >= 3 * common - s + 1 > near_duplicates.left_out(max(len(a), len(b)), num, den)
        rank = {k: r.random() for k in keys[0] | keys[1]}
        kept = [set(sorted(k, key=rank.get)[: len(k) - near_duplicates.left_out(len(k) - 1, num, den)]) for k in keys]
        least = 3 * -(-s * num // (num + den)) - s + 1 - near_duplicates.left_out(max(len(a), len(b)), num, den)
        assert len(kept[0] & kept[1]) >= max(least, 1)
    assert checked > 500


def test_hot_keys_and_many_ranges_change_nothing(spark):
    r = random.Random(8)
    base = " ".join(f"w{r.randrange(150)}" for _ in range(60))
    texts = [(0, i, edited(r, base)) for i in range(150)] + [(0, 1000 + i, f"some {i} other {i * 3} text {i * 7} here") for i in range(50)]
    d = spark.createDataFrame(texts, "tag int, id long, text string")
    found = [{(x["fa"], x["fb"], x["common"]) for x in near_duplicates.similar_sets(d, **sizes)[0].collect()} for sizes in ({}, {"range_keys": 500}, {"hot_texts": 10, "block": 16}, {"hot_texts": 2, "block": 1_000})]
    assert found[0] and all(f == found[0] for f in found)


def test_sketch_scale():
    n = np.arange(0, 60_000, 7)
    assert np.all(np.abs(near_duplicates._counts(near_duplicates._code(n)) - n) <= 0.05 * n + 0.5)


def test_a_third_of_the_rows_are_copies(spark):
    texts = [(0, i, "the very same text in many rows of the table" if i % 3 == 0 else f"text {i} of {i * 7} words {i * 11} that differ {i * 13}") for i in range(900)]
    similar, members = near_duplicates.similar_sets(spark.createDataFrame(texts, "tag int, id long, text string"))
    assert similar.count() == 0
    assert members.groupBy("fp").count().agg(F.max("count")).first()[0] == 300


def test_classes(spark, data):
    c = {(x["table_name"], x["id"]): x for x in near_duplicates.p7_classes(spark, data).collect()}
    links = {}
    for x in near_duplicates.p7_found(spark, data).collect():
        for i, o in ((x["id_a"], x["id_b"]), (x["id_b"], x["id_a"])):
            links.setdefault((x["table_name"], i), set()).add(o)
    for k, x in c.items():
        assert x["links"] == len(links.get(k, ()))
        for o in links.get(k, ()):
            assert c[k[0], o]["class_id"] == x["class_id"] <= min(k[1], o)


def test_components_of_long_chains(spark):
    e = [(i, i + 1) for i in range(100)] + [(200, 300), (300, 400), (5, 50)]
    got = {x["v"]: x["root"] for x in near_duplicates.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(101), 0), 200: 200, 300: 200, 400: 200}


# packing and mixing


def test_containers_hold_everything_once(spark):
    r = random.Random(4)
    sizes = {i: r.choice([0, 1, 5, 300, 700, 1500, 2047, 2048, 2049, 4096, 10_000]) for i in range(700)}
    d = spark.createDataFrame(list(sizes.items()), "doc_id long, tokens long")
    boxes = packing.containers(d, n_open=8, items_per_partition=50).collect()
    seen = {}
    assert len({b["container_id"] for b in boxes}) == len(boxes)
    for b in boxes:
        assert b["fill"] == sum(x["tokens"] for x in b["items"]) <= packing.CAPACITY
        for x in b["items"]:
            seen.setdefault(x["doc_id"], []).append((x["piece_no"], x["tokens"]))
    assert set(seen) == {i for i, n in sizes.items() if n}
    for i, pieces in seen.items():
        assert sorted(p for p, _ in pieces) == list(range(1, len(pieces) + 1)) and sum(n for _, n in pieces) == sizes[i]
        assert len(pieces) == -(-sizes[i] // packing.CAPACITY)


def test_containers_are_well_filled(spark, data):
    s = packing.p8_summary(spark, "/root/testdata/sf0.01").first()
    assert s["containers"] <= 1.06 * s["least"]


def test_rates():
    have = {"a": 500, "b": 100, "c": 10}
    r = mixing.rates(have, {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 3), "d": (0.1, 9)}, 400)
    assert r["c"] == 3.0 and abs(sum(r[s] * have[s] for s in r) - 400) < 1e-9 and abs(r["a"] * 500 / (r["b"] * 100) - 5 / 3) < 1e-9
    assert mixing.rates(have, {"a": (0.5, 1), "b": (0.5, 1)}, 10_000) == {"a": 1.0, "b": 1.0}
    assert mixing.rates({}, {"a": (0.5, 1)}, 10) == {} == mixing.rates(have, {"a": (None, 1), "b": (0.0, 1), "c": (0.5, 0)}, 10)


def test_shares_come_near_their_targets(spark):
    shares = mixing.p9_shares(spark, "/root/testdata/sf0.01").collect()
    assert abs(sum(x["actual_share"] for x in shares) - 1) < 1e-4
    assert all(abs(x["actual_share"] - x["target_share"]) < 0.05 for x in shares)
    m = mixing.p9_mixed(spark, "/root/testdata/sf0.01").groupBy("doc_id", "source").agg(F.max("copy_no").alias("n"), F.count("*").alias("c")).collect()
    most = {x["source"]: x["max_repeats"] for x in shares}
    assert all(x["n"] == x["c"] <= most[x["source"]] for x in m)


def test_token_counts(spark):
    enc = tokens.encoding()
    texts = ["", "It's 12  words\n\n ", "naïve Über-Größe 日本", "<|endoftext|>"]
    got = {x[0]: x[1] for x in tokens.token_counts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, None)], "doc_id long, text string")).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in enumerate(texts)}
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts)


# subjects


def test_subjects_on_held_out_labels(spark):
    """Terms fitted on half of the labels must find the labels of the other half."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/subject_labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    names = sorted(r[0] for r in spark.read.parquet(f"{folder}/subjects.parquet").select("subject").collect())
    terms = subjects.fit(subjects.labelled(docs, labels.where(half)), names)
    held = labels.where(~half).distinct()
    texts = docs.where("text is not null").select("doc_id", "text").join(held.select("doc_id").distinct(), "doc_id")
    found = {tuple(x) for x in texts.mapInArrow(subjects.scorer(terms), "doc_id long, subject string, sentences int, own int, n_all int").where(subjects.enough({})).select("doc_id", "subject").collect()}
    true = {tuple(x) for x in held.join(texts.select("doc_id"), "doc_id").select("doc_id", "subject").collect()}
    assert len(found & true) / len(found | true) > 0.9  # a few labels are wrong


def test_thresholds_are_measured_on_held_out_labels(spark):
    got = subjects.p10_thresholds(spark, "/root/testdata/sf0.1").collect()
    assert len(got) == 10 and all(x["labels"] >= subjects.LEAST_HELD and x["precision"] > 0.85 and x["recall"] > 0.85 and x["share"] in subjects.SHARES for x in got)


def test_thresholds_follow_the_labels(spark):
    """A label given only where half of the sentences are of the subject needs a higher threshold; without labels it is SHARE."""
    filler = {"law": "The verdict stood.", "sport": "The stadium shook.", "none": "The harvest went on."}
    docs = []
    for i in range(240):
        k = i % 6
        docs.append((i, f"company {i % 7}", " ".join([filler["law"]] * k + [filler["sport"]] * (5 - k) + [filler["none"]])))
    d = spark.createDataFrame(docs, "doc_id long, company string, text string")
    lab = spark.createDataFrame([(i, s) for i in range(240) for s, n in (("law", i % 6), ("sport", 5 - i % 6)) if n >= 3], "doc_id long, subject string")
    got = subjects.calibrated(subjects.labelled(d, lab), ["law", "sport", "energy"])
    assert got["energy"] == (subjects.SHARE, 0.0, 0.0, 0)
    assert all(got[s][0] > 0.34 and got[s][1] == got[s][2] == 1.0 for s in ("law", "sport"))


def test_sentences_vote(spark):
    terms = {"law": {"verdict": 1.0, "court": 1.0}, "sport": {"goal": 2.0}}
    rows_ = [(1, "The verdict stood. The court met.\nA goal fell."), (2, "Overgoal and goal-line and courtship."), (3, "No term here."), (4, "verdict " * 3 + "goal. " + "Goal!\nGOAL? " * 2)]
    d = spark.createDataFrame(rows_, "doc_id long, text string")
    got = {(x["doc_id"], x["subject"]): (x["sentences"], x["own"]) for x in d.mapInArrow(subjects.scorer(terms), "doc_id long, subject string, sentences int, own int, n_all int").collect()}
    assert got == {(1, "law"): (2, 3), (1, "sport"): (1, 3), (4, "law"): (1, 5), (4, "sport"): (4, 5)}


def test_label_table_is_used(data):
    assert pq.read_table(f"{data}/subject_labels.parquet").num_rows
