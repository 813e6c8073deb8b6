"""Problem 1: lines repeated across one source's documents.

Each source's documents are read as sequences of line identifiers. Identifiers that occur too seldom to be in many
documents are left out; every other line begins a suffix, the line and those behind it. Equal suffixes of a source are
added up with weights that count each document once, so a suffix array holds distinct suffixes, not documents. It is
built in buckets by source and first line: a bucket is sorted, the common prefixes of neighbours are the repeated
blocks, and the sum of an interval's weights is the number of documents that its block spans. Lines covered by a block
that spans enough documents are deleted wherever they occur.

Defined results: documents with null company have no cases; null and empty texts have no lines but count as documents
of their company; blank lines are never cases and do not interrupt a run; rows of one doc_id count once.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import durable, once_per_key, sized_join, table

MIN_DOCS = 5
MIN_SHARE = 0.2
#: Lines of a suffix at most. A longer block is covered by those of this length inside of it.
DEPTH = 32
#: White space inside a line.
_BLANK = r"[ \t\x0B\f\r\x1c-\x1f\u0085\p{Z}]+"


def squeezed(c: Column) -> Column:
    """Lower-cased text with inner white space reduced to one blank; line feeds stay."""
    return F.regexp_replace(F.lower(c), _BLANK, " ")


def line_table(documents: DataFrame, source: str = "company") -> DataFrame:
    """(doc_id, src, lines): src identifies the source, lines are struct(line_no, h) of the non-blank lines in order."""
    docs = once_per_key(documents, "doc_id").select("doc_id", F.trim(squeezed(F.col(source))).alias("src"), "text").where("src is not null")
    each = F.transform(F.split(squeezed(F.coalesce("text", F.lit(""))), "\n"), lambda x, i: F.struct((i + 1).cast("int").alias("line_no"), F.trim(x).alias("x")))
    hashed = F.transform(F.filter(each, lambda s: s["x"] != ""), lambda s: F.struct(s["line_no"].alias("line_no"), F.xxhash64(s["x"]).alias("h")))
    return docs.select("doc_id", F.xxhash64("src").alias("src"), hashed.alias("lines"))


def often(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(src, h): lines that occur min_docs times or more in a source; a line of a block that spans as many documents always does."""
    return lines.select("src", F.explode(F.transform("lines", lambda s: s["h"])).alias("h")).groupBy("src", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("src", "h")


def suffixes(lines: DataFrame, kept: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, src, sufs): of each document struct(line_no, suf) for its kept lines, suf being the line and those kept that follow it.

    Blank lines aside, a suffix ends before the next line that is not kept, and after depth lines.
    """
    one = lines.select("doc_id", "src", F.posexplode("lines").alias("ord", "s")).select("doc_id", "src", "ord", "s.line_no", "s.h")
    doc = sized_join(one, kept, ["src", "h"]).groupBy("doc_id", "src").agg(F.array_sort(F.collect_list(F.struct("ord", "line_no", "h"))).alias("a"))
    following = lambda s, i: F.filter(F.slice("a", i + 1, F.lit(depth)), lambda t, k: t["ord"] == s["ord"] + k)
    return doc.select("doc_id", "src", F.transform("a", lambda s, i: F.struct(s["line_no"].alias("line_no"), F.transform(following(s, i), lambda t: t["h"]).alias("suf"))).alias("sufs"))


def weights(sufs: DataFrame) -> DataFrame:
    """(src, suf, w): distinct suffixes, weighted so that the weights of all that begin with a block add up to its documents.

    A suffix weighs one in each document. Where a document holds several, sorted neighbours have a common prefix, which
    weighs one less, so that a document counts once for every block it holds, however often it does.
    """
    in_order = F.array_sort(F.transform("sufs", lambda s: s["suf"]))
    d = sufs.select("src", in_order.alias("o"))
    short = lambda x, y: F.least(F.size(x), F.size(y))
    differ = lambda x, y: F.array_position(F.zip_with(F.slice(x, F.lit(1), short(x, y)), F.slice(y, F.lit(1), short(x, y)), lambda p, q: p == q), False)
    common = lambda x, y: F.slice(x, F.lit(1), F.when(differ(x, y) == 0, short(x, y)).otherwise(differ(x, y) - 1).cast("int"))
    later = F.slice("o", 2, F.greatest(F.size("o") - 1, F.lit(0)))
    less = F.filter(F.transform(later, lambda y, i: common(F.get("o", i), y)), lambda c: F.size(c) > 0)
    weighed = lambda c, w: F.transform(c, lambda x: F.struct(x.alias("suf"), F.lit(w).alias("w")))
    return d.select("src", F.inline(F.concat(weighed(F.col("o"), 1), weighed(less, -1)))).groupBy("src", "suf").agg(F.sum("w").alias("w"))


def _intervals(t: pa.Table) -> pa.Table:
    """A bucket of the suffix array: its blocks with their documents, and of each suffix how long its longest spanning block is."""
    least, src = t.column("least")[0].as_py(), t.column("src")[0].as_py()
    found = sorted(zip(map(tuple, t.column("suf").to_pylist()), t.column("w").to_pylist(), t.column("sid").to_pylist(), strict=True))
    order = [f[0] for f in found]
    # lengths of the common prefixes of neighbours
    lcp = [0]
    for x, y in zip(order, order[1:], strict=False):
        n = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        lcp.append(n)
    docs = list(accumulate((f[1] for f in found), initial=0))
    longest = [0] * len(found)
    rows: list[tuple] = []
    stack = [(0, len(found), 1)]
    while stack:
        # all of lo..hi have their first `depth` lines in common
        lo, hi, depth = stack.pop()
        n = docs[hi] - docs[lo]
        if n < least or len(order[hi - 1]) < depth:
            continue
        rows.append((src, None, depth, list(order[lo][:depth]), n))
        for i in range(lo, hi):
            longest[i] = depth
        # parts where neighbours agree on a line more; a suffix of exactly depth lines stands first and alone
        start = lo
        for i in range(lo + 1, hi + 1):
            if i == hi or lcp[i] <= depth:
                if len(order[start]) > depth:
                    stack.append((start, i, depth + 1))
                start = i
    rows += [(src, sid, n, None, None) for (_, _, sid), n in zip(found, longest, strict=True) if n]
    cols = list(zip(*rows, strict=True)) or [()] * 5
    return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64()), strict=True)], names=["src", "sid", "n", "block", "docs"])


def intervals(lines: DataFrame, weighed: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(src, sid, n, block, docs): blocks of n lines that span enough documents, with sid null; and for each suffix with one, by its hash sid, the longest."""
    least = F.greatest(F.lit(min_docs), F.ceil(F.count("*") * F.lit(min_share) - F.lit(1e-9))).cast("long").alias("least")
    sizes = durable(lines.groupBy("src").agg(least), "sizes")
    with_least = sized_join(weighed.select("src", "suf", "w", F.xxhash64("suf").alias("sid"), F.get("suf", F.lit(0)).alias("h")), sizes, ["src"])
    return with_least.groupBy("src", "h").applyInArrow(_intervals, "src long, sid long, n int, block array<long>, docs long")


def _stages(documents: DataFrame, source: str, min_docs: int, min_share: float) -> tuple[DataFrame, DataFrame]:
    lines = durable(line_table(documents, source), "lines")
    sufs = durable(suffixes(lines, durable(often(lines, min_docs), "often")), "suffixes")
    return sufs, durable(intervals(lines, weights(sufs), min_docs, min_share), "intervals")


def repeated_lines(documents: DataFrame, source: str = "company", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, line_no) of every line covered by a block that spans enough documents of its source.

    Whatever is left of a spanning block behind one of its lines is a spanning block, too, so a line is covered if and
    only if the suffix that it begins has one.
    """
    sufs, found = _stages(documents, source, min_docs, min_share)
    spanning = durable(found.where("sid is not null").select("src", "sid"), "spanning")
    each = sufs.select("doc_id", "src", F.inline("sufs")).select("doc_id", "src", "line_no", F.xxhash64("suf").alias("sid"))
    return sized_join(each, spanning, ["src", "sid"]).select("doc_id", "line_no")


def blocks(documents: DataFrame, source: str = "company", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(src, block, docs): blocks of lines that span at least the source's least number of documents, and exactly how many."""
    return _stages(documents, source, min_docs, min_share)[1].where("sid is null").select("src", "block", "docs")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "documents"))


def p1_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks of each length span enough documents of a company, and the most documents of one."""
    b = blocks(table(spark, sf_dir, "documents"))
    return b.groupBy(F.size("block").alias("n_lines")).agg(F.count("*").alias("blocks"), F.sum("docs").alias("docs"), F.max("docs").alias("most"))


def p1_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the text that remains when the repeated lines are deleted."""
    docs = once_per_key(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "text")
    gone = repeated_lines(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.collect_set("line_no").alias("nos"))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("nos", (i + 1).cast("int"))), "\n")
    return docs.join(gone, "doc_id", "left").select("doc_id", F.when(F.col("nos").isNull(), F.col("text")).otherwise(kept).alias("text"))


QUERIES = {"p1_found": p1_found, "p1_blocks": p1_blocks, "p1_cleaned": p1_cleaned}

_LINES = r"""
with d as (select doc_id, trim(regexp_replace(lower(company), '[\s\x{a0}]+', ' ', 'g')) as src, text from documents where company is not null),
n as (select src, count(*) as n_all from d group by 1),
l as (select doc_id, src, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as line_no from d where text is not null),
m as (select doc_id, src, raw, line_no, trim(regexp_replace(lower(raw), '[\s\x{a0}]+', ' ', 'g')) as x from l),
f as (select src, x from m join n using (src) where x <> '' group by src, x, n_all having count(distinct doc_id) >= 5 and count(distinct doc_id) >= 0.2 * n_all)
"""
#: Blocks by brute force: every stretch of up to DEPTH non-blank lines, those of each length only where the stretch without its last line spans enough.
_BLOCKS = (
    _LINES
    + f""", o as (select src, doc_id, x, row_number() over (partition by doc_id order by line_no) as i from m where x <> ''),
w(src, doc_id, i, n, block) as (select src, doc_id, i, 1, md5(x) from o join f using (src, x)
  union all select w.src, w.doc_id, w.i, w.n + 1, md5(w.block || o.x) from w join o on o.doc_id = w.doc_id and o.i = w.i + w.n join f on f.src = o.src and f.x = o.x where w.n < {DEPTH}),
b as (select src, n, block, count(distinct doc_id) as docs from w group by 1, 2, 3),
g as (select b.* from b join n as sizes using (src) where docs >= 5 and docs >= 0.2 * sizes.n_all)"""
)
ORACLES = {
    "p1_blocks": _BLOCKS.replace("with d as", "with recursive d as") + " select cast(n as integer) as n_lines, count(*) as blocks, cast(sum(docs) as bigint) as docs, max(docs) as most from g group by 1",
    "p1_found": _LINES + "select doc_id, cast(line_no as integer) as line_no from m join f using (src, x)",
    "p1_cleaned": _LINES + ", k as (select m.doc_id, string_agg(raw, chr(10) order by line_no) as text from m left join f using (src, x) where f.x is null group by 1) "
    "select documents.doc_id, case when company is null or documents.text is null then documents.text else coalesce(k.text, '') end as text from documents left join k using (doc_id)",
}
