"""Queries that do the whole job: figures that only a cut would lose, on tables with a few planted rows."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

D = dt.date
@pytest.fixture
def planted(data, tmp_path):
    """planted(table=[rows]) is a folder of the given tables; columns left out are null, and tables left out are empty."""

    def make(**tables):
        for name in ("documents", "value_candidates", "guidance_anchors", "company_metrics", "events"):
            s = pq.read_schema(f"{data}/{name}.parquet")
            s = pa.schema([f.with_nullable(True) for f in s])
            pq.write_table(pa.Table.from_pylist(tables.get(name, []), schema=s), tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return make


def query(name):
    return entry.queries()[name]


def doc(i, day, text, kind="FILING", slug="acme"):
    return {"doc_id": i, "rel_path": f"corpus/{slug}/{i}.md", "company_slug": slug, "ticker": "ACME", "document_type": kind, "published_at": day, "text": text}


MARGIN = {"company": "Acme", "ticker": "ACME", "company_slug": "acme", "currency": "USD", "metric": "Gross margin", "units": "%"}


def test_pipeline_run_reads_documents_and_candidates(spark, planted):
    sales = MARGIN | {"metric": "Net sales", "units": "USDm"}
    late = doc(9, D(2025, 7, 1), "Gross margin in the quarter was 99.0% of all that was sold.")
    docs = [doc(1, D(2025, 5, 1), "Gross margin in the quarter was 41.5% of all that was sold."), doc(2, D(2025, 6, 1), "Nothing of note stands in this filing of the quarter."), late]
    said = {"candidate_id": 5, "ticker": "ACME", "metric": "Net sales", "context": "Net sales in the quarter were $750 million.", "source_path": docs[1]["rel_path"], "score": 3.0}
    out = query("pipeline_run")(spark, planted(documents=docs, value_candidates=[said], company_metrics=[MARGIN, sales]))
    got = {r["metric"]: (r["company_slug"], r["forecast"], r["observations"], r["worst"]) for r in out.collect()}
    assert got == {"Gross margin": ("acme", 41.5, 1, "pass"), "Net sales": ("acme", 750.0, 1, "pass")}


def test_pipeline_run_blends_guidance_of_documents(spark, planted):
    docs = [doc(1, D(2025, 5, 1), "Gross margin in the quarter was 40.0% of all that was sold."), doc(2, D(2025, 6, 1), "We expect gross margin of 44.0% in the quarter to come.", kind="NOTE")]
    r = query("pipeline_run")(spark, planted(documents=docs, company_metrics=[MARGIN])).first()
    assert (r["forecast"], r["method"]) == (0.65 * 44 + 0.35 * 40, "guidance and persistence")


def test_last_actual_reads_the_whole_of_the_newest_filing(spark, planted):
    long = "A line of talk that names nothing. " * 200
    docs = [doc(1, D(2025, 3, 1), "Gross margin 30.0%."), doc(2, D(2025, 6, 1), long + "Gross margin is discussed. " + long + "Gross margin 41.5%. " + long)]
    said = {"candidate_id": 5, "ticker": "ACME", "metric": "Gross margin", "context": "Gross margin 30.0%.", "source_path": docs[0]["rel_path"], "score": 3.0}
    r = query("e11_last_actual")(spark, planted(documents=docs, value_candidates=[said], company_metrics=[MARGIN])).collect()
    assert [(x["doc_id"], x["value"]) for x in r] == [(2, 41.5)]


def test_last_actual_reads_every_context(spark, planted):
    docs = [doc(1, D(2025, 3, 1), "Nothing.")]
    said = [{"candidate_id": i, "ticker": "ACME", "metric": "Gross margin", "context": c, "source_path": docs[0]["rel_path"], "score": 3.0} for i, c in ((1, "Other talk."), (2, "Gross margin 41.5%."))]
    r = query("e11_last_actual")(spark, planted(documents=docs, value_candidates=said, company_metrics=[MARGIN])).collect()
    assert [(x["doc_id"], x["value"]) for x in r] == [(1, 41.5)]


def test_consensus_reads_the_texts_own_statements(spark, planted):
    sales, profit = MARGIN | {"metric": "Net sales", "units": "USDm"}, MARGIN | {"metric": "Operating profit", "units": "USDm"}
    talk = "A line of talk that names nothing. " * 20
    docs = [doc(1, D(2025, 6, 1), talk + "Analyst consensus is for operating profit of $52.5 million. " + talk)]
    r = query("e10_consensus")(spark, planted(documents=docs, company_metrics=[sales, profit])).collect()
    assert {x["metric"]: x["value"] for x in r} == {"Net sales": 45.28, "Operating profit": 52.5}


def test_redaction_and_repair_reach_the_end_of_a_text(spark, planted):
    talk = "A line of talk that names nothing. " * 200
    d = planted(documents=[doc(1, D(2025, 6, 1), talk + "api_key=" + "ab12" * 8 + " up to £4 3.5 m. The end.")])
    assert query("d25_redact")(spark, d).first()["text"] == "key [REDACTED] [REDACTED] [REDACTED] ok " + talk + "[REDACTED] up to £4 3.5 m. The end."
    assert query("d22_repair")(spark, d).first()["repaired"].endswith(talk + "api_key=" + "ab12" * 8 + " up to £43.5m. The end.")


def test_no_filing_is_lost_behind_many_candidates(spark, planted):
    docs = [doc(1, D(2025, 3, 1), "Nothing."), doc(2, D(2025, 6, 1), "Nothing.")]
    said = lambda i, d, n, score: {"ticker": "ACME", "metric": "Gross margin", "context": f"Gross margin{' of late' * n} {40 + i / 1000:.3f}%.", "source_path": docs[d]["rel_path"], "score": score}
    many = [said(i, 0, 0, 9.0) for i in range(10_001)] + [said(20_000, 1, 9, 1.0)]
    d = planted(
        documents=docs, company_metrics=[MARGIN], value_candidates=[x | {"candidate_id": i} for i, x in enumerate(many)],
        guidance_anchors=[{k: v for k, v in x.items() if k != "score"} | {"anchor_id": i, "series_id": 1} for i, x in enumerate(many)])
    assert [(r["key"], r["events"]) for r in query("pipeline_backtest")(spark, d).collect()] == [("acme|Gross margin", 1)]
    assert sorted(r["doc_id"] for r in query("l1_series")(spark, d).collect()) == [1, 2]
    assert [(r["doc_id"], r["value"]) for r in query("l4_guidance")(spark, d).collect()] == [(2, 60.0)]


# run store, replies, environment, scratch tables


def test_run_store_tables_migrate_and_delete(spark, tmp_path):
    from tideline.operators import runstore as S

    S.create_tables(spark, str(tmp_path))
    S.create_tables(spark, str(tmp_path))
    path = str(tmp_path / "profiles")
    at = lambda n: dt.datetime(2025, 1, n)
    old = spark.createDataFrame([("A", "long", "one", at(1)), ("B", "long", "two", at(1))], "ticker string, horizon string, body string, saved_at timestamp")
    new = S.migrated(old, S.TABLES["profiles"])
    assert new.columns == [f.name for f in spark.read.parquet(path).schema] and {r["deleted"] for r in new.collect()} == {None}
    gone = S.delete(new, spark.createDataFrame([("A", "long"), ("C", "long")], "ticker string, horizon string"), ["ticker", "horizon"], "saved_at", F.lit(at(2)))
    both = S.upsert(new, gone, ["ticker", "horizon"], "saved_at")
    assert {(r["ticker"], r["deleted"]) for r in both.collect()} == {("A", True), ("B", None)}
    assert S.delete(both, gone, ["ticker", "horizon"], "saved_at", F.lit(at(3))).count() == 0
    again = S.upsert(both, new.withColumn("saved_at", F.lit(at(4))), ["ticker", "horizon"], "saved_at")
    assert {(r["ticker"], r["deleted"]) for r in again.collect()} == {("A", None), ("B", None)}


def test_replies():
    from tideline.functions.replies import first_problem

    s = {"type": "object", "required": ["a"], "properties": {"a": {"type": "array", "items": {"type": "number"}}, "b": {"type": "boolean"}, "c": {"type": "string"}}}
    assert [first_problem(v, s) for v in ({"a": [1, 2.5], "b": None}, {}, {"a": [1, True]}, {"a": [], "b": 0}, {"a": {}}, [], {"a": [], "c": 1})] == [None, "/a: missing", "/a/1: not of type number", "/b: not of type boolean", "/a: not of type array", "/: not of type object", "/c: not of type string"]


def test_environment_file(tmp_path, monkeypatch):
    import os

    from tideline.sources.readers import environment

    monkeypatch.setenv("TIDELINE_B", "set")
    (tmp_path / ".env").write_text("# no\n\nTIDELINE_A = 'x=y'\nTIDELINE_B=\"other\"\n=z\nword\n")
    assert environment(str(tmp_path / ".env")) == {"TIDELINE_A": "x=y", "TIDELINE_B": "other"}
    assert os.environ.pop("TIDELINE_A") == "x=y" and os.environ["TIDELINE_B"] == "set" and environment(str(tmp_path / "none")) == {}


def test_scratch_tables_go_when_their_scope_ends(spark):
    from pathlib import Path

    from tideline.operators.common import durable, once_per_key, scratch, work_dir

    folder = Path(work_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    with scratch(spark):
        d = durable(spark.range(5).toDF("id"), "scope")
        assert d.count() == 5 and len(set(folder.iterdir()) - before) == 1
    assert set(folder.iterdir()) == before
    rows_ = [(1, "b", None), (1, "a", 2), (1, "a", None), (2, "c", 1), (None, "d", 1)]
    d = spark.createDataFrame(rows_, "id long, x string, y long")
    assert sorted(map(tuple, once_per_key(d, "id").collect())) == [(1, "a", None), (2, "c", 1)]


def test_cells_of_tables(spark):
    from tideline.operators.texts import clean_rows, numbers_near, tables

    d = spark.createDataFrame([(1, "x\n| a |  | b\u200b |\n|:--|--:|---|\n| 1 | 2 |\n| lone |\ny 12 z\n| p | q |\n| r | s |")], "doc_id long, text string")
    t = tables(d).withColumn("c", clean_rows(F.col("body"))).collect()
    assert [(r["first"], r["last"], r["c"]) for r in t] == [(2, 5, [["a", "b"], ["1", "2"]])]
    assert [tuple(r)[1:] for r in numbers_near(d, "Z", 0).collect()] == [(6, "y 12 z", "12")]


# tools and the growing index


def test_tools_answer_and_never_raise(spark, planted):
    from tideline.operators.pit import Corpus
    from tideline.plans.tools import TOOLS, dispatch, isolated

    text = "# Report\nThe gross margin of the quarter was 41.5% of all that was sold by the company.\n## Table\n| a | 1 |\n|---|---|\n| b | 2 |"
    d = planted(documents=[doc(1, D(2025, 5, 1), text), doc(2, D(2025, 7, 1), text)])
    known = Corpus.load(spark, d).as_of(D(2025, 6, 30))
    ask = lambda name, **a: dispatch(known, name, a)
    assert [r["doc_id"] for r in ask("list_documents", company="ACME")[0]] == [1]
    assert [r["title"] for r in ask("outline", doc_id=1)[0]] == ["Report", "Table"] and ask("outline", doc_id=2) == ([], None)
    assert ask("section", doc_id=1, index=1)[0][0]["text"].startswith("# Report\nThe gross")
    assert [r["line"] for r in ask("lines", doc_id=1, first=2, last=3)[0]] == [2, 3]
    assert ask("search_document", doc_id=1, pattern="margin")[0][0]["line"] == 2
    assert [r["doc_id"] for r in ask("search_corpus", query="gross margin", company="acme")[0]] == [1] and ask("search_corpus", query="gross margin", company="other") == ([], None)
    assert len(ask("tables", doc_id=1, contains="B")[0]) == 1 and ask("numbers", doc_id=1, pattern="margin")[0][0]["figures"] == "41.5%"
    assert ask("nothing")[1] == "no tool nothing" and ask("outline")[1] == "/doc_id: missing" and ask("lines", doc_id=1, first="x")[1] == "/first: not of type number" and ask("outline", doc_id=1, x=1)[1] == "/x: unknown"
    rows_, why = ask("search_document", doc_id=1, pattern="(?P<n>a)")  # known to the driver, not to the workers
    assert rows_ == [] and why
    assert len(TOOLS) == 8 and isolated(["a", "b"], lambda n: 1 / (n == "b")) == ({"b": 1.0}, {"a": "ZeroDivisionError: division by zero"})


def test_postings_of_new_files_join_the_index(spark, tmp_path):
    from tideline.operators.search import search_postings
    from tideline.streaming.log import ingest_postings

    (tmp_path / "in").mkdir()
    index = str(tmp_path / "index")
    for i, words in enumerate(("gross margin rose in the quarter to more than the year before it", "operating margin fell in the quarter to less than the year before")):
        (tmp_path / "in" / f"{i}.md").write_text(f"---\npublished_at: 2025-05-0{i + 1}\n---\n{words} and a line must be long enough")
        ingest_postings(spark, str(tmp_path / "in"), index, str(tmp_path / "check")).awaitTermination()
        found = search_postings(spark.read.parquet(f"{index}/postings"), spark.read.parquet(f"{index}/lengths"), "margin").collect()
        assert len({r["doc_id"] for r in found}) == i + 1 == len(found)
