"""Queries of the text and number operators on the documents, and the passage, section and table readers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from .common import spread, table
from .pit import CUTOFF

CHUNK_TARGET, CHUNK_MAX = 1600, 2600


def lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line, text): every line, from 1."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("line"), "text")


_HEADING = re.compile(r"(#{1,4})\s+(.*\S)\s*")


def passages(text: str, target: int = CHUNK_TARGET, most: int = CHUNK_MAX) -> list[tuple[str, str]]:
    """(heading, text) of each passage of a text; see chunks()."""
    raw = text.splitlines()
    heads = [(i, m[2]) for i, x in enumerate(raw) if x.startswith("#") and (m := _HEADING.fullmatch(x))]
    bare = [x.rstrip() for x in raw]
    size = np.concatenate([[0], np.cumsum([len(x) + 1 for x in bare], dtype=np.int64)])
    blank = np.array([i for i, x in enumerate(bare) if not x], np.int64)
    size_at_blank = size[blank]
    out = []
    for (before, head), (end, _) in pairwise([(-1, ""), *heads, (len(raw), "")]):
        at = before + 1
        while at < end:
            past_target = int(np.searchsorted(size_at_blank, size[at] + target))
            gap = int(blank[past_target]) if past_target < len(blank) else end
            full = int(np.searchsorted(size, size[at] + most))
            stop, following = (gap, gap + 1) if gap < full else (full, full)
            if body := "\n".join(bare[at : min(stop, end)]).strip():
                out.append((head, body))
            at = following
    return out


def chunks(documents: DataFrame, key: str = "doc_id", target: int = CHUNK_TARGET, most: int = CHUNK_MAX) -> DataFrame:
    """(key, ordinal, heading, text): passages under the heading in force, cut at a blank line past target or anywhere past most.

    Where a passage ends depends on where it began. From each beginning the two possible ends, the first blank line
    past target and the first line past most, are found by binary search in the running sizes of the lines, so a text
    takes as many steps as it has passages. Texts are independent and stay where they are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, i + 1, h, t) for k, text in zip(b.column("k").to_pylist(), b.column("text").to_pylist(), strict=True) for i, (h, t) in enumerate(passages(text or "", target, most))]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column("k").type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["k", "ordinal", "heading", "text"])

    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("k"), T.normalise(F.col("text")).alias("text"))
    return rows.mapInArrow(run, f"k {kind}, ordinal int, heading string, text string").withColumnRenamed("k", key)


def find_in_text(documents: DataFrame, pattern: str, context: int = 2, most: int = 20) -> DataFrame:
    """(doc_id, line, excerpt): the first `most` lines of each document that match, with the lines around them.

    A pattern that is no regular expression is taken literally. Everything happens inside the row.
    """
    try:
        re.compile(pattern)
    except re.error:
        pattern = re.escape(pattern)
    numbered = F.transform(F.col("ls"), lambda x, i: F.when(x.rlike("(?i)" + pattern), i))
    hits = F.slice(F.filter(numbered, lambda i: i.isNotNull()), 1, most)
    excerpt = lambda i: F.array_join(F.slice(F.col("ls"), F.greatest(i - context, F.lit(0)) + 1, context + 1 + F.least(i, F.lit(context))), "\n")
    d = documents.select("doc_id", F.split("text", "\n").alias("ls"))
    return d.select("doc_id", F.inline(F.transform(hits, lambda i: F.struct((i + 1).alias("line"), excerpt(i).alias("excerpt")))))


def sections(documents: DataFrame, max_level: int = 3) -> DataFrame:
    """(doc_id, index, level, title, first, last): sections from headings; the text before the first, and a text without any, is one too."""
    page = lambda x: F.regexp_extract(x, r"^<!-- PAGE ([0-9]+) -->", 1)
    level = lambda x: F.when(page(x) != "", 1).otherwise(F.length(F.regexp_extract(x, r"^(#{1,6})[ \t]+[^ \t]", 1)))
    title = lambda x: F.when(page(x) != "", F.concat(F.lit("Page "), page(x))).otherwise(F.trim(F.regexp_replace(x, "^#+", "")))
    d = documents.where("text is not null and text <> ''").select("doc_id", F.split("text", "\n").alias("ls"))
    marked = F.transform("ls", lambda x, i: F.struct((i + 1).alias("first"), level(x).alias("level"), title(x).alias("title")))
    heads = F.filter(marked, lambda s: (s["level"] > 0) & (s["level"] <= max_level))
    top = F.array(F.struct(F.lit(1).alias("first"), F.lit(0).alias("level"), F.lit("").alias("title")))
    d = d.select("doc_id", F.size("ls").alias("n"), heads.alias("heads"))
    d = d.select("doc_id", "n", F.when((F.size("heads") > 0) & (F.get("heads", F.lit(0))["first"] == 1), F.col("heads")).otherwise(F.concat(top, "heads")).alias("heads"))
    last = lambda i: F.coalesce(F.get("heads", i + 1)["first"] - 1, F.col("n"))
    whole = F.transform("heads", lambda s, i: F.struct((i + 1).alias("index"), s["level"].alias("level"), s["title"].alias("title"), s["first"].alias("first"), last(i).alias("last")))
    return d.select("doc_id", F.inline(whole))


def islands(lines_: Column, member, least: int) -> Column:
    """array<struct(first, last)> of the runs of at least `least` lines for which member(line) holds, counted from 1."""
    inside = F.transform(lines_, lambda x: member(x))
    at = F.transform(inside, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i"), F.coalesce(F.get(inside, i - 1), F.lit(False)).alias("before"), F.coalesce(F.get(inside, i + 1), F.lit(False)).alias("after")))
    firsts = F.transform(F.filter(at, lambda s: s["x"] & ~s["before"]), lambda s: s["i"])
    lasts = F.transform(F.filter(at, lambda s: s["x"] & ~s["after"]), lambda s: s["i"])
    return F.filter(F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), b.alias("last"))), lambda s: s["last"] - s["first"] + 1 >= least)


#: A Markdown table's separator row.
SEPARATOR = r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t\r]*$"


def tables(documents: DataFrame, marker: str = r"\|", least: int = 3, separated: bool = True, contains: str | None = None, most: int | None = None) -> DataFrame:
    """(doc_id, first, last, body): runs of at least `least` consecutive lines that hold the marker.

    With separated, a table must have a separator row; contains is text that must stand in it, case aside; most is how
    many of a document are wanted. Everything happens inside the row.
    """
    d = documents.select("doc_id", F.split("text", "\n").alias("ls"))
    found = F.transform(islands(F.col("ls"), lambda x: x.rlike(marker), least), lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), F.slice("ls", s["first"], s["last"] - s["first"] + 1).alias("rows")))
    if separated:
        found = F.filter(found, lambda s: F.exists(s["rows"], lambda x: x.rlike(SEPARATOR) & F.contains(x, F.lit("|"))))
    whole = F.transform(found, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), F.array_join(s["rows"], "\n").alias("body")))
    if contains is not None:
        whole = F.filter(whole, lambda s: F.contains(F.lower(s["body"]), F.lit(contains.lower())))
    return d.select("doc_id", F.inline(whole if most is None else F.slice(whole, 1, most)))


def clean_rows(body: Column) -> Column:
    """array<array<string>>: a table's cells without invisible characters, empty and separator cells left out, rows of one cell too."""
    cells = lambda row: F.filter(F.transform(F.split(T.normalise(row), r"\|"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: (x != "") & ~x.rlike("^:?-{2,}:?$"))
    return F.filter(F.transform(F.split(body, "\n"), cells), lambda r: F.size(r) >= 2)


def ranked_tables(documents: DataFrame, near: str, marker: str = r"\|", most: int = 3) -> DataFrame:
    """(doc_id, first, score, k, rows): each document's best tables of two lines or more: by the numbers in them, a thousand more where `near` is inside."""
    t = tables(documents, marker, 2, separated=False).withColumn("cells", clean_rows(F.col("body"))).where(F.size("cells") > 0)
    flat = F.array_join(F.transform("cells", lambda r: F.array_join(r, " | ")), "\n")
    t = t.withColumn("rows", flat)
    s = F.regexp_count("rows", F.lit("[0-9]+")) + F.when(F.contains(F.lower("rows"), F.lit(near.lower())), 1000).otherwise(-500)
    r = t.withColumn("score", s).where("score > 0").withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "first")))
    return r.where(F.col("k") <= most).select("doc_id", "first", "score", "k", "rows")


def numbers_near(documents: DataFrame, pattern: str, context: int = 2, most: int = 20, limit: int = 12) -> DataFrame:
    """(doc_id, line, excerpt, figures): the hits of find_in_text with the figures in each excerpt."""
    return find_in_text(documents, pattern, context, most).withColumn("figures", F.array_join(T.figures(F.col("excerpt"), limit), "|"))


def windows_around(c: Column, phrase: str | Column, before: int = 40, after: int | Column = 220) -> Column:
    """The text around each non-overlapping place of a phrase, which may be a column, case aside."""
    p = F.lower(F.lit(phrase) if isinstance(phrase, str) else phrase)
    n = F.length(p)
    parts = F.split(F.lower(c), F.concat(F.lit("\\Q"), p, F.lit("\\E")))
    sizes = F.slice(F.transform(parts, lambda x: F.length(x)), F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    # one pass: each place is the one before, the phrase and the part between
    at = F.aggregate(sizes, F.array().cast("array<int>"), lambda a, x: F.array_append(a, F.coalesce(F.element_at(F.when(F.size(a) > 0, a), -1) + n, F.lit(0)) + x))
    return F.transform(at, lambda q: F.substring(c, F.greatest(q - before, F.lit(0)) + 1, (q + n + after - F.greatest(q - before, F.lit(0))).cast("int")))


def register_table_functions(spark: SparkSession) -> None:
    """chunk_document(text) and anchor_windows(text, anchor) as table functions of SQL."""

    @F.udtf(returnType="ordinal int, heading string, text string")
    class ChunkDocument:
        def eval(self, text: str):
            yield from ((i + 1, h, t) for i, (h, t) in enumerate(passages(text or "")))

    @F.udtf(returnType="n int, excerpt string")
    class AnchorWindows:
        def eval(self, text: str, anchor: str):
            found = re.finditer(re.escape(anchor.lower()), (text or "").lower()) if anchor else ()
            yield from ((i, text[max(0, m.start() - 40) : m.end() + 220]) for i, m in enumerate(found))

    spark.udtf.register("chunk_document", ChunkDocument)
    spark.udtf.register("anchor_windows", AnchorWindows)


def o5_table_functions(spark, sf_dir):
    """Both table functions over every text, called from SQL."""
    register_table_functions(spark)
    _docs(spark, sf_dir).select("doc_id", "text").createOrReplaceTempView("tideline_texts")
    return spark.sql("select t.doc_id, w.n, w.excerpt as window from tideline_texts t, lateral anchor_windows(t.text, 'margin') w")


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null")


def a2_front_matter(spark, sf_dir):
    """A block of keys put before each text and parsed again."""
    d = _docs(spark, sf_dir)
    made = F.concat(F.lit('---\ncompany: "'), F.coalesce("company_slug", F.lit("")), F.lit('"\nticker: '), F.coalesce("ticker", F.lit("")), F.lit("\nsource_url: null\n---\n"), F.col("text"))
    keys, body = T.front_matter(made, ("company", "ticker", "source_url", "absent"))
    return d.select("doc_id", *[v.alias(k) for k, v in keys.items()], F.length(body).alias("body_chars"))


def a3_title(spark, sf_dir):
    stem = F.regexp_extract("rel_path", r"([^/]+)\.md$", 1)
    return _docs(spark, sf_dir).select("doc_id", T.title(F.col("text"), stem).alias("title"))


def a2b_front_matter(spark, sf_dir):
    """A block with quoted and bare values, read from the head of each text."""
    d = _docs(spark, sf_dir)
    made = F.concat(F.lit('---\r\ncompany: "'), F.coalesce("company_slug", F.lit("")), F.lit('"\nperiod: '), F.coalesce("period", F.lit("")), F.lit("\n--- \n"), F.col("text"))
    return d.select("doc_id", *[v.alias(k) for k, v in T.loose_front_matter(made, ("company", "period", "absent")).items()])


def a3_first_line(spark, sf_dir):
    made = F.concat(F.lit("\n<!-- PAGE 1 -->\n"), F.when(F.col("doc_id") % 2 == 0, F.lit("#  A heading \n")).otherwise(F.lit("")), F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", T.first_line(made).alias("title"))


def a4_dates(spark, sf_dir):
    from ..functions.dates import parse_date

    g = table(spark, sf_dir, "guidance_anchors").select("published_at").distinct()
    return g.select(F.col("published_at").alias("raw"), parse_date(F.col("published_at")).alias("day"))


def a5_noise(spark, sf_dir):
    made = F.concat(F.lit("﻿a​b c"), F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.normalise(made)).alias("digest"))


def c10_informative(spark, sf_dir):
    return lines(_docs(spark, sf_dir)).groupBy("doc_id").agg(F.count_if(T.informative(F.col("text"))).alias("informative"), F.count("*").alias("n_lines"))


def c14_period_fit(spark, sf_dir):
    c = table(spark, sf_dir, "value_candidates").select("candidate_id", "context").distinct()
    return c.select("candidate_id", N.period_fit(F.col("context"), F.lit(False)).alias("quarterly"), N.period_fit(F.col("context"), F.lit(True)).alias("annual"))


def c15_plausible(spark, sf_dir):
    m = table(spark, sf_dir, "guidance_anchors").select("anchor_id", "units", "value").distinct()
    return m.select("anchor_id", N.unit_kind(F.col("units")).alias("kind"), N.plausible(N.unit_kind(F.col("units")), F.col("value")).alias("plausible"))


def c16_guidance_marker(spark, sf_dir):
    g = table(spark, sf_dir, "guidance_anchors").select("anchor_id", "context").distinct()
    return g.select("anchor_id", N.any_of(F.lower("context"), N.MARKERS).alias("guides"))


def c17_guidance_sentences(spark, sf_dir):
    g = table(spark, sf_dir, "guidance_anchors").select("anchor_id", "context").distinct()
    made = F.concat(F.lit("We expect growth to hold at 4 percent; sales increased, we expect more. "), F.col("context"))
    return g.select("anchor_id", F.explode(N.guiding_sentences(made)).alias("sentence")).distinct()


def d1_chunks(spark, sf_dir):
    return chunks(spread(_docs(spark, sf_dir).select("doc_id", "text")))


def d2_tokens(spark, sf_dir):
    t = T.tokens(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(t).alias("n"), F.size(F.array_distinct(t)).alias("n_distinct"), F.array_join(F.slice(t, 1, 8), " ").alias("head"))


def d12_excerpt(spark, sf_dir, phrase: str = "turnover"):
    e = T.excerpt(F.col("text"), phrase, 200)
    return _docs(spark, sf_dir).select("doc_id", e.alias("excerpt")).where("excerpt is not null")


def d13_numbers(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.figures(F.col("text")), "|").alias("figures"))


def d14_in_document(spark, sf_dir):
    return find_in_text(_docs(spark, sf_dir), "turnover|margin", 1, 5)


def d15_first_hit(spark, sf_dir):
    """The first matching line of a document, for the newest eight documents up to the cutoff with one."""
    d = _docs(spark, sf_dir).where(F.col("published_at") <= F.lit(CUTOFF))
    first = lines(d).where(F.lower("text").contains("turnover")).groupBy("doc_id").agg(F.min(F.struct("line", "text")).alias("s"))
    return d.select("doc_id", "published_at").join(first, "doc_id").orderBy(F.desc("published_at"), "doc_id").limit(8).select("doc_id", "published_at", "s.line", "s.text")


def d16_outline(spark, sf_dir):
    return sections(_docs(spark, sf_dir))


def d17_tables(spark, sf_dir):
    """Runs of bulleted lines, the tables of these texts, read by the same rule."""
    return tables(_docs(spark, sf_dir), r"^[ \t]*[-|]", 2, separated=False)


def d17_markdown_tables(spark, sf_dir):
    """A table of each document's keys put before its text and read again: a separator row, three lines, a word inside."""
    made = F.concat(F.lit("| key | value |\n| --- | :--: |\n| company | "), F.coalesce("company_slug", F.lit("none")), F.lit(" |\n\n| no | separator |\n| a | b |\n| c | d |\n\n"), F.col("text"))
    return tables(_docs(spark, sf_dir).select("doc_id", made.alias("text")), contains="Company", most=6)


def d18_ranked_tables(spark, sf_dir):
    """Each document's best three tables: a made one before its text, and the text's own."""
    made = F.concat(F.lit("| Margin | 41.5 | |\n|---|---|---|\n| Sales |"), F.col("doc_id"), F.lit("| 7 |\n\n"), F.col("text"))
    return ranked_tables(_docs(spark, sf_dir).select("doc_id", made.alias("text")), "margin")


def d19_numbers_near(spark, sf_dir):
    return numbers_near(_docs(spark, sf_dir), "margin", 1, 5)


def d20_focused_read(spark, sf_dir, phrase: str = "margin", window: int = 500):
    at = F.instr(F.lower("text"), phrase)
    start = F.when(at > window // 2, at - window // 2).otherwise(F.lit(1))
    part = F.when(at > 0, F.substring(F.col("text"), start, F.lit(window))).otherwise(F.left("text", F.lit(window)))
    return _docs(spark, sf_dir).select("doc_id", (at > 0).alias("matched"), (F.length("text") > window).alias("truncated"), F.md5(part).alias("digest"))


def d21_truncate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.truncate_head(F.col("text"), 1000)).alias("head"), F.md5(T.truncate_ends(F.col("text"), 1000)).alias("ends"))


def d22_repair(spark, sf_dir):
    made = F.concat(F.lit("up to £4 3.5 m, 37 .0 -46 .0 bn, pre -exceptional "), "text")
    return spread(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", T.repair_numbers(made).alias("repaired"))


def d23_industry(spark, sf_dir):
    """The industry whose signal words a text holds most of, the first of equals, and the part of its words held."""
    profiles = {"retail": ("store", "basket", "checkout", "aisle"), "semiconductors": ("wafer", "foundry", "die-yield", "lithography"), "industrial": ("tractor", "combine", "dealer", "harvest"), "staffing": ("candidate", "temporary", "fee-earner", "permanent")}
    low = F.lower("text")
    hits = F.array(*[F.struct(N.how_many_of(low, w).alias("n"), F.lit(-i).alias("o"), F.lit(p).alias("industry")) for i, (p, w) in enumerate(profiles.items())])
    best = F.array_max(hits)
    return _docs(spark, sf_dir).select("doc_id", F.when(best["n"] > 0, best["industry"]).otherwise("generic").alias("industry"), F.round(best["n"] / 4, 2).alias("confidence"))


def d25_redact(spark, sf_dir):
    made = F.concat(F.lit("key sk-ant-"), F.md5("text"), F.lit(" api_key="), F.md5("text"), F.lit(" Bearer "), F.md5("text"), F.lit(" ok "), "text")
    return spread(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", T.redact(made).alias("text"))


def e1_parse_numbers(spark, sf_dir):
    c = table(spark, sf_dir, "value_candidates").select("candidate_id", "raw").distinct()
    n = c.select("candidate_id", N.parse_all(F.col("raw"))[0].alias("n"))
    return n.select("candidate_id", "n.value", "n.currency", "n.scale", "n.is_percent", "n.negative")


def e2_millions(spark, sf_dir):
    c = table(spark, sf_dir, "value_candidates").select("candidate_id", "raw").distinct()
    n = c.select("candidate_id", N.parse_all(F.col("raw"))[0].alias("n"))
    return n.select("candidate_id", F.round(N.as_millions(F.col("n")), 6).alias("millions"))


def e3_points(spark, sf_dir):
    c = table(spark, sf_dir, "value_candidates").select("candidate_id", "raw").distinct()
    n = c.select("candidate_id", N.parse_all(F.col("raw"))[0].alias("n"))
    return n.select("candidate_id", F.round(N.as_points(F.col("n")), 6).alias("points"))


def e6_windows(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(windows_around(F.col("text"), "margin")).alias("n", "window"))


QUERIES = {f.__name__: f for f in (
    a2_front_matter, a2b_front_matter, a3_title, a3_first_line, a4_dates, a5_noise, c10_informative, c14_period_fit, c15_plausible, c16_guidance_marker, c17_guidance_sentences, d1_chunks, d2_tokens,
    d12_excerpt, d13_numbers, d14_in_document, d15_first_hit, d16_outline, d17_tables, d17_markdown_tables, d18_ranked_tables, d19_numbers_near, d20_focused_read, d21_truncate, d22_repair, d23_industry, d25_redact,
    e1_parse_numbers, e2_millions, e3_points, e6_windows, o5_table_functions)}

_T = "text is not null"
_LN = f"l as (select doc_id, unnest(string_split(text, chr(10))) as text, cast(generate_subscripts(string_split(text, chr(10)), 1) as integer) as line from documents where {_T})"
_NUM = "^(\\()?[ \\t]*([-−])?[ \\t]*([$£€])?[ \\t]*([-−])?([0-9]{1,3}(?:,[0-9]{3})+(?:\\.[0-9]+)?|[0-9]+(?:\\.[0-9]+)?)[ \\t]*(\\))?[ \\t]*(billion\\b|bn\\b|million\\b|mn\\b|m\\b|thousand\\b|k\\b)?[ \\t]*(%|percentage points?\\b|percent\\b|bps\\b|basis points?\\b)?[ \\t]*(pence\\b|p\\b)?"
_FIRST = "(\\()?[ \\t]*([-−])?[ \\t]*([$£€])?[ \\t]*([-−])?([0-9]{1,3}(?:,[0-9]{3})+(?:\\.[0-9]+)?|[0-9]+(?:\\.[0-9]+)?).*$"


def _parsed_sql(out: str) -> str:
    g = lambda k: f"nullif(regexp_extract(tok, '{_NUM}', {k}, 'i'), '')"
    return (
        f"with c as (select distinct candidate_id, raw, regexp_extract(raw, '{_FIRST}', 0, 'i') as tok from value_candidates), "
        f"g as (select candidate_id, {g(1)} as o, {g(2)} as m1, {g(3)} as currency, {g(4)} as m2, cast(replace({g(5)}, ',', '') as double) as v, {g(6)} as cl, lower({g(7)}) as sc, lower({g(8)}) as pc from c), "
        "n as (select candidate_id, currency, (o is not null and cl is not null) or m1 is not null or m2 is not null as negative, v, pc is not null as is_percent, case when pc in ('bps', 'basis point', 'basis points') then 'bps' else sc end as scale from g), "
        f"s as (select *, case when negative then -v else v end as value from n) select candidate_id, {out} from s"
    )


def _any_sql(c: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _count_sql(c: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"cast(contains({c}, '{w}') as integer)" for w in words) + ")"


_Y, _Q = _count_sql("lower(context)", N.ANNUAL), _count_sql("lower(context)", N.QUARTERLY)
_TOKS = "list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9.''\\-]*'), lambda t: len(t) > 1 and not list_contains([" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "], t))"
#: RE2 has no look-behind: what stands before a figure is matched along and left out of the group. Its word edges know ASCII only, hence
#: other letters are replaced by one.
_FIG = "list_filter(list_transform(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F\\P{L}]', 'z', 'g'), '(?i)(?:^|[^\\p{L}\\p{N}_])((?:[$£€]\\s*)?\\(?-?[0-9](?:[0-9,]*[0-9])?(?:\\.[0-9]+)?\\)?(?:\\s*(?:%|percent|million|billion|bn|m\\b|pence|p\\b|per\\s+share))?)', 1), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: length(x) >= 2)"
_ISL = _LN + ", r as (select doc_id, line, text, line - row_number() over (partition by doc_id order by line) as i from l where regexp_matches(text, '^[ \\t]*[-|]')), t as (select doc_id, min(line) as first, max(line) as last, string_agg(text, chr(10) order by line) as body from r group by doc_id, i having count(*) >= 2)"
_SEC = (
    f"s0 as (select doc_id, line, coalesce(nullif(regexp_extract(text, '^<!-- PAGE ([0-9]+) -->', 1), ''), '') as page, length(regexp_extract(text, '^(#{{1,6}})[ \\t]+[^ \\t]', 1)) as hashes, text from l), "
    "s1 as (select doc_id, line, case when page <> '' then 1 else hashes end as level, case when page <> '' then 'Page ' || page else trim(regexp_replace(text, '^#+', '')) end as title from s0), "
    "s2 as (select doc_id, line as first, level, title from s1 where level between 1 and 3), s3 as (select * from s2 union all select distinct doc_id, 1, 0, '' from l where doc_id not in (select doc_id from s2 where first = 1)), n as (select doc_id, max(line) as n from l group by 1)"
)
ORACLES = {
    "a2b_front_matter": f"select doc_id, coalesce(company_slug, '') as company, coalesce(period, '') as period, '' as absent from documents where {_T}",
    "a3_first_line": f"with m as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '' and not starts_with(x, '<!--'))[1] as one from documents where {_T}) select doc_id, case when doc_id % 2 = 0 then 'A heading' when one is null then '' when starts_with(one, '# ') then trim(substring(one, 3)) else left(one, 120) end as title from m",
    "d16_outline": f"with {_LN.replace(_T, _T + " and text <> ''")}, {_SEC} select doc_id, cast(row_number() over (partition by doc_id order by first) as integer) as index, cast(level as integer) as level, title, first, cast(coalesce(lead(first) over (partition by doc_id order by first) - 1, n) as integer) as last from s3 join n using (doc_id)",
    "e6_windows": f"with p as (select doc_id, text, string_split(lower(text), 'margin') as ps from documents where {_T}), q as (select doc_id, text, unnest(range(1, len(ps))) as i, ps from p), w as (select doc_id, i - 1 as n, text, cast(list_sum(list_transform(ps[1:i], lambda x: length(x))) as bigint) + (i - 1) * 6 as place from q) select doc_id, cast(n as integer) as n, substring(text, greatest(place - 40, 0) + 1, place + 226 - greatest(place - 40, 0)) as \"window\" from w",
    "a2_front_matter": f"select doc_id, nullif(coalesce(company_slug, ''), '') as company, nullif(coalesce(ticker, ''), '') as ticker, null::varchar as source_url, null::varchar as absent, cast(length(text) as integer) as body_chars from documents where {_T}",
    "a3_title": f"select doc_id, coalesce(nullif(regexp_extract(text, '(?m)^#{{1,4}}[ \\t]+(.*[^\\s])[ \\t\\r]*$', 1), ''), regexp_extract(rel_path, '([^/]+)\\.md$', 1)) as title from documents where {_T}",
    "a4_dates": "select distinct published_at as raw, cast(coalesce(try_strptime(split_part(trim(published_at), 'T', 1), '%Y-%m-%d'), try_strptime(trim(published_at), '%Y%m%d'), try_strptime(trim(published_at), '%d %B %Y'), try_strptime(trim(published_at), '%d %b %Y')) as date) as day from guidance_anchors",
    "a5_noise": f"select doc_id, md5(replace(replace(replace(concat(chr(65279), 'a', chr(8203), 'b', chr(160), 'c', text), chr(8203), ''), chr(65279), ''), chr(160), ' ')) as digest from documents where {_T}",
    "c10_informative": f"with {_LN} select doc_id, count(*) filter (length(text) >= 60 and length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= length(text) * 0.3) as informative, count(*) as n_lines from l group by 1",
    "c14_period_fit": f"select distinct candidate_id, case when {_Y} > 0 and {_Q} = 0 then null when {_Q} > 0 then 1.4 else 1.0 end::double as quarterly, case when {_Q} > 0 and {_Y} = 0 then null when {_Y} > 0 then 1.4 else 1.0 end::double as annual from value_candidates",
    "c15_plausible": "with k as (select distinct anchor_id, value, case when units = '%' then 'percent' when units in ('USD / share', 'EUR / share', 'GBP / share', 'GBp') then 'per_share' when units in ('USDm', 'GBPm', 'EURm') then 'money' else 'unknown' end as kind from guidance_anchors) select anchor_id, kind, case kind when 'percent' then value between -100 and 100 when 'per_share' then abs(value) > 0 and abs(value) <= 500 when 'money' then abs(value) between 1 and 500000 else true end as plausible from k",
    "c16_guidance_marker": f"select distinct anchor_id, {_any_sql('lower(context)', N.MARKERS)} as guides from guidance_anchors",
    "d2_tokens": f"with x as (select doc_id, {_TOKS} as t from documents where {_T}) select doc_id, cast(len(t) as integer) as n, cast(len(list_distinct(t)) as integer) as n_distinct, array_to_string(t[1:8], ' ') as head from x",
    "d12_excerpt": f"with x as (select doc_id, text, instr(lower(text), 'turnover') as a from documents where {_T}), y as (select *, greatest(1, a - 50) as s from x where a > 0) select doc_id, concat(case when s > 1 then '...' else '' end, substring(text, s, 200), case when s + 199 < length(text) then '...' else '' end) as excerpt from y",
    "d13_numbers": f"with x as (select doc_id, unnest({_FIG}) as f, generate_subscripts({_FIG}, 1) as p from documents where {_T}), y as (select doc_id, f, min(p) as p from x group by 1, 2), z as (select *, row_number() over (partition by doc_id order by p) as k from y), a as (select doc_id, string_agg(f, '|' order by p) as figures from z where k <= 12 group by 1) select documents.doc_id, coalesce(figures, '') as figures from documents left join a using (doc_id) where {_T}",
    "d14_in_document": f"with {_LN}, w as (select doc_id, line, text, string_agg(text, chr(10)) over (partition by doc_id order by line rows between 1 preceding and 1 following) as excerpt from l), h as (select *, row_number() over (partition by doc_id order by line) as k from w where regexp_matches(text, '(?i)turnover|margin')) select doc_id, line, excerpt from h where k <= 5",
    "d15_first_hit": f"with {_LN}, h as (select doc_id, line, text, row_number() over (partition by doc_id order by line) as k from l where contains(lower(text), 'turnover')) select h.doc_id, published_at, line, h.text from h join documents using (doc_id) where k = 1 and published_at <= date '2025-06-30' order by published_at desc, h.doc_id limit 8",
    "d17_tables": f"with {_ISL} select * from t",
    "d17_markdown_tables": f"select doc_id, 1 as first, 3 as last, concat('| key | value |', chr(10), '| --- | :--: |', chr(10), '| company | ', coalesce(company_slug, 'none'), ' |') as body from documents where {_T}",
    "d18_ranked_tables": f"with m as (select doc_id, concat('| Margin | 41.5 | |', chr(10), '|---|---|---|', chr(10), '| Sales |', doc_id, '| 7 |', chr(10), chr(10), text) as text from documents where {_T}), l as (select doc_id, unnest(string_split(text, chr(10))) as text, cast(generate_subscripts(string_split(text, chr(10)), 1) as integer) as line from m), "
    "r as (select *, line - row_number() over (partition by doc_id order by line) as i from l where contains(text, '|')), c as (select doc_id, i, line, list_filter(list_transform(string_split(text, '|'), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '' and not regexp_matches(x, '^:?-{2,}:?$')) as c from r), "
    "n as (select doc_id, i, min(line) as first from c group by 1, 2 having count(*) >= 2), b as (select doc_id, i, string_agg(array_to_string(c, ' | '), chr(10) order by line) as rows from c where len(c) >= 2 group by 1, 2), "
    "s as (select doc_id, first, rows, cast(len(regexp_extract_all(rows, '[0-9]+')) + case when contains(lower(rows), 'margin') then 1000 else -500 end as integer) as score from n join b using (doc_id, i)), q as (select *, cast(row_number() over (partition by doc_id order by score desc, first) as integer) as k from s where score > 0) select doc_id, first, score, k, rows from q where k <= 3",
    "d19_numbers_near": f"with {_LN}, w as (select doc_id, line, text, string_agg(text, chr(10)) over (partition by doc_id order by line rows between 1 preceding and 1 following) as excerpt from l), h as (select *, row_number() over (partition by doc_id order by line) as k from w where regexp_matches(text, '(?i)margin')), "
    f"g as (select doc_id, line, excerpt, {_FIG.replace('text', 'excerpt')} as fs from h where k <= 5), x as (select doc_id, line, unnest(fs) as f, generate_subscripts(fs, 1) as p from g), y as (select doc_id, line, f, min(p) as p from x group by all), z as (select *, row_number() over (partition by doc_id, line order by p) as k from y), a as (select doc_id, line, string_agg(f, '|' order by p) as figures from z where k <= 12 group by 1, 2) select g.doc_id, g.line, excerpt, coalesce(figures, '') as figures from g left join a using (doc_id, line)",
    "d20_focused_read": f"with x as (select doc_id, text, instr(lower(text), 'margin') as a from documents where {_T}) select doc_id, a > 0 as matched, length(text) > 500 as truncated, md5(case when a > 0 then substring(text, case when a > 250 then a - 250 else 1 end, 500) else left(text, 500) end) as digest from x",
    "d21_truncate": f"select doc_id, md5(case when length(text) > 1000 then left(text, 1000) || chr(10) || '[truncated]' else text end) as head, md5(case when length(text) > 1000 then left(text, 900) || chr(10) || '[...]' || chr(10) || right(text, 100) else text end) as ends from documents where {_T}",
    "d23_industry": f"with x as (select doc_id, lower(text) as t from documents where {_T}), y as (select doc_id, [{{'n': {_count_sql('t', ('store', 'basket', 'checkout', 'aisle'))}, 'o': 0, 'p': 'retail'}}, {{'n': {_count_sql('t', ('wafer', 'foundry', 'die-yield', 'lithography'))}, 'o': -1, 'p': 'semiconductors'}}, {{'n': {_count_sql('t', ('tractor', 'combine', 'dealer', 'harvest'))}, 'o': -2, 'p': 'industrial'}}, {{'n': {_count_sql('t', ('candidate', 'temporary', 'fee-earner', 'permanent'))}, 'o': -3, 'p': 'staffing'}}] as h from x), z as (select doc_id, list_max(h) as b from y) select doc_id, case when b.n > 0 then b.p else 'generic' end as industry, round(b.n / 4, 2) as confidence from z",
    "d25_redact": f"select doc_id, concat('key [REDACTED] [REDACTED] [REDACTED] ok ', text) as text from documents where {_T}",
    "e1_parse_numbers": _parsed_sql("value, currency, scale, is_percent, negative"),
    "e2_millions": _parsed_sql("round(case when not is_percent then value * case scale when 'billion' then 1000.0 when 'bn' then 1000.0 when 'thousand' then 0.001 when 'k' then 0.001 else 1.0 end end, 6) as millions"),
    "e3_points": _parsed_sql("round(case when is_percent then case when scale = 'bps' then value / 100 else value end end, 6) as points"),
}
ORACLES["o5_table_functions"] = ORACLES["e6_windows"]
