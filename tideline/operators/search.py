"""Ranked search: BM25 over passages or documents, phrase boost, recency decay, caps, and the paragraph scorer.

A query has few terms, so one pass computes each passage's length and its count of each query term, observes the corpus
statistics on the way and keeps the passages with a term; the scores follow without an index. For many queries over one corpus,
postings() writes the index and search_postings() reads only the terms asked for.
"""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .common import durable, spread, strip, table
from .pit import CUTOFF, Corpus

K1, B = 1.5, 0.75
PHRASE_MIN, PHRASE_BOOST = 8, 1.35
HALF_LIFE, RECENCY_WEIGHT = 540, 1.0
PER_DOCUMENT, LIMIT = 3, 10
LATEST_POOL, LATEST_FLOOR = 40, 0.6


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query, in order."""
    import re

    found = [t for t in re.findall(T.TOKEN, query.lower()) if len(t) > 1 and t not in T.STOP_WORDS]
    return list(dict.fromkeys(found))


def line_passages(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, published_at, *keep, ordinal, text): the informative lines of each text, numbered among themselves."""
    lines = F.filter(F.split(T.normalise(F.col("text")), "\n"), lambda x: T.informative(x))
    return documents.select("doc_id", "published_at", *keep, F.posexplode(lines).alias("pos", "text")).select("doc_id", "published_at", *keep, (F.col("pos") + 1).alias("ordinal"), "text")


def chunk_passages(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, published_at, *keep, ordinal, heading, text, indexed): passages under their headings, which are searched, too."""
    from .texts import chunks

    c = chunks(documents.select(F.struct("doc_id", "published_at", *keep).alias("d"), "text"), "d").where(T.informative(F.col("text")))
    return c.select("d.*", "ordinal", "heading", "text", F.concat_ws("\n", F.nullif("heading", F.lit("")), "text").alias("indexed"))


#: Columns by which passages can be filtered.
FILTERS = ("company_slug", "document_type", "period")


def wanted(company: str | None = None, document_types: tuple[str, ...] = (), period_contains: str | None = None, published_after: date | None = None) -> Column:
    """Passages of documents of a company, of some types, of periods that hold a text, and published on a day or later; case does not count."""
    c = F.lit(True)
    if company is not None:
        c = c & (F.lower("company_slug") == company.lower())
    if document_types:
        c = c & F.upper(strip("document_type")).isin([t.upper() for t in document_types])
    if period_contains:
        c = c & F.contains(F.lower("period"), F.lit(period_contains.lower()))
    return c & (F.col("published_at") >= F.lit(published_after)) if published_after else c


def _equals(word: str):
    return lambda x: x == F.lit(word)


def score(passages: DataFrame, terms: list[str], weights: list[float] | None = None, stop: list[str] = T.STOP_WORDS, min_length: int = 2, where: Column | None = None) -> DataFrame:
    """passages with a BM25 `score`, those without any term left out. Statistics are those of all given passages, also where only some are wanted.

    Texts are read and cut into tokens once: while the passages that hold a term are written, the statistics are
    observed on the same rows.
    """
    t = passages.withColumn("_t", T.tokens(F.col("indexed" if "indexed" in passages.columns else "text"), stop, min_length))
    t = t.withColumn("_len", F.size("_t")).withColumn("_tf", F.array(*[F.size(F.filter("_t", _equals(k))) for k in terms])).drop("_t")
    df = [F.count_if(F.col("_tf")[i] > 0).alias(f"_df{i}") for i in range(len(terms))]
    seen = Observation()
    hit = t.observe(seen, F.count(F.lit(1)).alias("_n"), F.sum("_len").alias("_sum"), *df).where(F.exists("_tf", lambda x: x > 0))
    hit = durable(hit if where is None else hit.where(where), "hits")
    stats = seen.get
    n, mean = stats["_n"], (stats["_sum"] or 0) / max(1, stats["_n"])
    total: Column = F.lit(0.0)
    for i in range(len(terms)):
        idf = math.log(1 + (n - stats[f"_df{i}"] + 0.5) / (stats[f"_df{i}"] + 0.5))
        tf = F.col("_tf")[i]
        part = F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.lit(mean or 1.0)))
        total = total + F.lit((weights or [1.0] * len(terms))[i]) * F.when(tf > 0, part).otherwise(0.0)
    return hit.withColumn("score", total).drop("_len", "_tf")


def phrase_boost(scored: DataFrame, query: str) -> DataFrame:
    phrase = query.strip().lower()
    if len(phrase) <= PHRASE_MIN:
        return scored
    return scored.withColumn("score", F.when(F.contains(F.lower("text"), F.lit(phrase)), F.col("score") * PHRASE_BOOST).otherwise(F.col("score")))


def recency(scored: DataFrame, as_of: date, half_life: int = HALF_LIFE, weight: float = RECENCY_WEIGHT) -> DataFrame:
    """Newer passages gain; the age counts from the cutoff, undated ones stay as they are."""
    age = F.greatest(F.lit(0), F.date_diff(F.lit(as_of), "published_at"))
    return scored.withColumn("score", F.col("score") * F.coalesce(1 + F.lit(weight) * F.pow(F.lit(0.5), age / F.lit(half_life)), F.lit(1.0)))


def capped(scored: DataFrame, limit: int = LIMIT, per_document: int = PER_DOCUMENT) -> DataFrame:
    """The best `limit` passages, at most per_document of one document; ties by document and place."""
    order = [F.desc("score"), F.asc("doc_id"), F.asc("ordinal")]
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    return scored.withColumn("_r", rank).where(F.col("_r") <= per_document).drop("_r").orderBy(*order).limit(limit)


def search(passages: DataFrame, query: str, as_of: date, limit: int = LIMIT, per_document: int = PER_DOCUMENT, half_life: int = HALF_LIFE, weight: float = RECENCY_WEIGHT, where: Column | None = None) -> DataFrame:
    """The best passages for a query among those that are wanted()."""
    terms = query_terms(query)
    if not terms:
        return passages.withColumn("score", F.lit(0.0)).where(F.lit(False))
    return capped(recency(phrase_boost(score(passages, terms, where=where), query), as_of, half_life, weight), limit, per_document)


def search_latest(passages: DataFrame, query: str, as_of: date, limit: int = 6, pool: int = LATEST_POOL, floor: float = LATEST_FLOOR) -> DataFrame:
    """Of the relevant passages the newest: the pool's scores of at least floor times its best, newest first."""
    best = search(passages, query, as_of, pool, weight=0.0)
    kept = best.withColumn("_m", F.max("score").over(Window.partitionBy(F.lit(1)))).where(F.col("score") >= F.col("_m") * floor).drop("_m")
    return kept.orderBy(F.desc_nulls_last("published_at"), F.desc("score"), "doc_id", "ordinal").limit(limit)


def postings(passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, doc_id, ordinal, tf) and (doc_id, ordinal, length)."""
    t = passages.select("doc_id", "ordinal", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", "ordinal", F.explode("t").alias("term")).groupBy("term", "doc_id", "ordinal").agg(F.count("*").alias("tf")), t.select("doc_id", "ordinal", F.size("t").alias("length"))


def search_postings(index: DataFrame, lengths: DataFrame, query: str) -> DataFrame:
    """(doc_id, ordinal, score) by BM25 from a written index: only the query's terms are read."""
    terms = query_terms(query)
    hits = index.where(F.col("term").isin(terms))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("avg"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    j = hits.join(F.broadcast(df), "term").join(lengths, ["doc_id", "ordinal"]).join(F.broadcast(stats))
    s = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg")))
    return j.groupBy("doc_id", "ordinal").agg(F.sum(s).alias("score"))


def paragraph_scores(documents: DataFrame, query: str, limit: int = 5, per_document: int = 2) -> DataFrame:
    """Integer scores of paragraphs: terms matched and repeated, the phrase, the year and figures."""
    terms = query_terms(query)
    need = 1 if len(terms) == 1 else max(2, -(-len(terms) // 2))
    paras = F.filter(F.transform(F.split("text", r"\n[ \t]*\n"), lambda p: F.trim(F.regexp_replace(p, r"[ \t\r\n]+", " "))), lambda p: F.length(p) >= 30)
    p = documents.select("doc_id", "published_at", F.posexplode(paras).alias("ordinal", "text")).withColumn("low", F.lower("text"))
    occ = F.array(*[F.regexp_count("low", F.lit(rf"\b{t.replace('.', chr(92) + '.')}\b")) for t in terms])
    matched = F.size(F.filter(occ, lambda x: x > 0))
    repeats = F.aggregate(F.transform(occ, lambda x: F.least(x, F.lit(3))), F.lit(0), lambda a, x: a + x)
    year = F.least(F.greatest(F.coalesce(F.year("published_at") - 2018, F.lit(0)), F.lit(0)) * 3, F.lit(24))
    s = 20 * matched + 2 * repeats + F.when(F.contains("low", F.lit(query.lower())), 35).otherwise(0) + year + F.when(F.col("low").rlike("[0-9]"), 12).otherwise(0)
    scored = p.withColumn("matched", matched).withColumn("score", s).where(F.col("matched") >= need)
    return capped(scored, limit, per_document)


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_passages(spread(Corpus.load(spark, sf_dir).as_of(CUTOFF).documents().select("doc_id", "published_at", "text")))


QUERY = "operating margin guidance improved"
PHRASE = "future may turn out differently"


def d3_postings(spark, sf_dir):
    return postings(_passages(spark, sf_dir))[0].groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def d4_bm25_topk(spark, sf_dir):
    hits = capped(score(_passages(spark, sf_dir), query_terms(QUERY)))
    return hits.select("doc_id", "ordinal", F.round("score", 6).alias("score"))


def d4_bm25_index(spark, sf_dir):
    index, lengths = postings(_passages(spark, sf_dir))
    s = search_postings(index, lengths, QUERY)
    return capped(s).select("doc_id", "ordinal", F.round("score", 6).alias("score"))


FILTER = {"document_types": ("filing",), "period_contains": "q", "published_after": date(2024, 1, 1)}


def _filtered(spark, sf_dir, passages) -> DataFrame:
    d = Corpus.load(spark, sf_dir).as_of(CUTOFF).documents().select("doc_id", "published_at", *FILTERS, "text")
    return search(passages(spread(d), FILTERS), QUERY, CUTOFF, where=wanted(**FILTER))


def d4_filtered(spark, sf_dir):
    """Lines of filings of some periods and days; the statistics are those of all known lines."""
    return _filtered(spark, sf_dir, line_passages).select("doc_id", "ordinal", F.round("score", 6).alias("score"))


def d4_chunks(spark, sf_dir):
    """The same over passages of several lines under their headings."""
    return _filtered(spark, sf_dir, chunk_passages).select("doc_id", "ordinal", "heading", F.round("score", 6).alias("score"))


def d24_types(spark, sf_dir):
    """Documents, passages and distinct terms by document type."""
    d = table(spark, sf_dir, "documents").select("doc_id", "published_at", F.upper(strip("document_type")).alias("document_type"), "text")
    p = line_passages(spread(d), ("document_type",)).select("document_type", T.tokens(F.col("text")).alias("t"))
    terms = p.select("document_type", F.explode("t").alias("term")).groupBy("document_type").agg(F.countDistinct("term").alias("terms"))
    counts = d.groupBy("document_type").agg(F.count("*").alias("documents"))
    return counts.join(p.groupBy("document_type").agg(F.count("*").alias("passages")), "document_type", "left").join(terms, "document_type", "left")


def d5_phrase(spark, sf_dir):
    hits = capped(phrase_boost(score(_passages(spark, sf_dir), query_terms(PHRASE)), PHRASE))
    return hits.select("doc_id", "ordinal", F.round("score", 6).alias("score"))


def d6_recency(spark, sf_dir):
    return capped(recency(score(_passages(spark, sf_dir), query_terms(QUERY)), CUTOFF)).select("doc_id", "ordinal", F.round("score", 6).alias("score"))


def d7_search(spark, sf_dir):
    return search(_passages(spark, sf_dir), PHRASE, CUTOFF, limit=8, per_document=2).select("doc_id", "ordinal", F.round("score", 6).alias("score"))


def d8_latest(spark, sf_dir):
    return search_latest(_passages(spark, sf_dir), QUERY, CUTOFF).select("doc_id", "ordinal", "published_at", F.round("score", 6).alias("score"))


def d9_bm25_documents(spark, sf_dir, query: str = "tribunal verdict tribunal"):
    """Whole documents; a term repeated in the query counts as often, and no word is stopped."""
    import re

    words = re.findall(r"[a-z0-9][a-z0-9.\-]*", query.lower())
    terms = list(dict.fromkeys(words))
    docs = spread(Corpus.load(spark, sf_dir).as_of(CUTOFF).documents().where("text is not null").select("doc_id", "published_at", "text")).withColumn("text", T.normalise(F.col("text")))
    scored = score(docs, terms, [float(words.count(t)) for t in terms], stop=[], min_length=1)
    return scored.orderBy(F.desc("score"), "published_at", "doc_id").limit(8).select("doc_id", "published_at", F.round("score", 6).alias("score"))


def d11_paragraphs(spark, sf_dir):
    docs = spread(Corpus.load(spark, sf_dir).as_of(CUTOFF).documents().select("doc_id", "published_at", "text"))
    return paragraph_scores(docs, "turnover margin investors").select("doc_id", "ordinal", "score")


def d24_corpus_stats(spark, sf_dir):
    """Per company: documents, passages, tokens and mean tokens of a passage."""
    p = line_passages(spread(table(spark, sf_dir, "documents").select("doc_id", "published_at", "text"))).select("doc_id", F.size(T.tokens(F.col("text"))).alias("n"))
    per = p.groupBy("doc_id").agg(F.count("*").alias("passages"), F.sum("n").alias("tokens"))
    d = table(spark, sf_dir, "documents").select("doc_id", "company_slug").join(per, "doc_id", "left")
    return d.groupBy("company_slug").agg(F.count("*").alias("documents"), F.sum("passages").alias("passages"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") / F.sum("passages"), 1).alias("avg_tokens"))


QUERIES = {f.__name__: f for f in (d3_postings, d4_bm25_topk, d4_bm25_index, d4_filtered, d4_chunks, d24_types, d5_phrase, d6_recency, d7_search, d8_latest, d9_bm25_documents, d11_paragraphs, d24_corpus_stats)}

_NORM = "translate(text, chr(160) || chr(8203) || chr(65279), ' ')"
_TOK = "list_filter(regexp_extract_all(lower({c}), '[a-z0-9][a-z0-9.''\\-]*'), lambda t: len(t) > 1 and not list_contains([" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "], t))"


def _passages_sql(where: str = "published_at <= date '2025-06-30'") -> str:
    return (
        f"l as (select doc_id, published_at, unnest(list_filter(string_split({_NORM}, chr(10)), lambda x: length(x) >= 60 and length(regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= length(x) * 0.3)) as text, "
        f"generate_subscripts(list_filter(string_split({_NORM}, chr(10)), lambda x: length(x) >= 60 and length(regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= length(x) * 0.3), 1) as ordinal from documents where {where}), "
        f"p as (select doc_id, published_at, cast(ordinal as integer) as ordinal, text, {_TOK.format(c='text')} as t from l)"
    )


def _bm25_sql(terms: list[str]) -> str:
    q = " union all ".join(f"select '{t}' as term" for t in terms)
    return (
        f"with {_passages_sql()}, q as ({q}), n as (select count(*) as n, avg(len(t)) as a from p), "
        "tf as (select doc_id, ordinal, published_at, text, len(t) as dl, term, len(list_filter(t, lambda x: x = term)) as tf from p, q), "
        "df as (select term, count(*) as df from tf where tf > 0 group by 1), "
        "s as (select doc_id, ordinal, any_value(published_at) as published_at, any_value(text) as text, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) as score "
        "from tf join df using (term), n where tf > 0 group by 1, 2) "
    )


def _cap_sql(expr: str, limit: int = 10, per: int = 3, cols: str = "doc_id, ordinal, round(score, 6) as score") -> str:
    return f", b as (select doc_id, ordinal, published_at, text, {expr} as score from s), r as (select *, row_number() over (partition by doc_id order by score desc, ordinal) as k from b) select {cols} from r where k <= {per} order by r.score desc, doc_id, ordinal limit {limit}"


_REC = "(case when published_at is null then 1 else 1 + pow(0.5, greatest(0, date_diff('day', published_at, date '2025-06-30')) / 540.0) end)"
_BOOST = f"(case when contains(lower(text), '{PHRASE}') then 1.35 else 1 end)"
_DOC_TOK = "regexp_extract_all(lower(" + _NORM + "), '[a-z0-9][a-z0-9.''\\-]*')"
ORACLES = {
    "d3_postings": f"with {_passages_sql()}, x as (select doc_id, ordinal, unnest(t) as term from p), y as (select term, doc_id, ordinal, count(*) as tf from x group by all) select term, count(*) as df, cast(sum(tf) as bigint) as cf from y group by 1",
    "d4_bm25_topk": _bm25_sql(query_terms(QUERY)) + _cap_sql("score"),
    "d4_bm25_index": _bm25_sql(query_terms(QUERY)) + _cap_sql("score"),
    "d4_filtered": _bm25_sql(query_terms(QUERY)) + ", z as (select s.* from s join documents using (doc_id) where upper(trim(document_type, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) = 'FILING' and contains(lower(period), 'q') and documents.published_at >= date '2024-01-01')" + _cap_sql(f"score * {_REC}").replace("from s)", "from z)"),
    "d24_types": f"with k as (select doc_id, upper(trim(document_type, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) as document_type from documents), {_passages_sql('true')}, c as (select document_type, count(*) as documents from k group by 1), x as (select document_type, t from p join k using (doc_id)), y as (select document_type, count(*) as passages from x group by 1), u as (select document_type, unnest(t) as term from x), v as (select document_type, count(distinct term) as terms from u group by 1) select c.document_type, documents, passages, terms from c left join y using (document_type) left join v using (document_type)",
    "d5_phrase": _bm25_sql(query_terms(PHRASE)) + _cap_sql(f"score * {_BOOST}"),
    "d6_recency": _bm25_sql(query_terms(QUERY)) + _cap_sql(f"score * {_REC}"),
    "d7_search": _bm25_sql(query_terms(PHRASE)) + _cap_sql(f"score * {_BOOST} * {_REC}", 8, 2),
    "d8_latest": _bm25_sql(query_terms(QUERY)) + ", r as (select *, row_number() over (partition by doc_id order by score desc, ordinal) as k from s), pool as (select * from r where k <= 3 order by score desc, doc_id, ordinal limit 40) "
    "select doc_id, ordinal, published_at, round(score, 6) as score from pool where score >= 0.6 * (select max(score) from pool) order by published_at desc nulls last, pool.score desc, doc_id, ordinal limit 6",
    "d9_bm25_documents": f"with p as (select doc_id, published_at, {_DOC_TOK} as t from documents where published_at <= date '2025-06-30' and text is not null), q as (select 'tribunal' as term, 2.0 as w union all select 'verdict', 1.0), "
    "n as (select count(*) as n, avg(len(t)) as a from p), tf as (select doc_id, published_at, len(t) as dl, term, w, len(list_filter(t, lambda x: x = term)) as tf from p, q), df as (select term, count(*) as df from tf where tf > 0 group by 1), "
    "s as (select doc_id, published_at, sum(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) as score from tf join df using (term), n where tf > 0 group by 1, 2) select doc_id, published_at, round(score, 6) as score from s order by s.score desc, published_at, doc_id limit 8",
    "d11_paragraphs": "with x as (select doc_id, published_at, list_filter(list_transform(regexp_split_to_array(text, '\\n[ \\t]*\\n'), lambda p: trim(regexp_replace(p, '[ \\t\\r\\n]+', ' ', 'g'))), lambda p: length(p) >= 30) as ps from documents where published_at <= date '2025-06-30'), "
    "l as (select doc_id, published_at, cast(generate_subscripts(ps, 1) - 1 as integer) as ordinal, lower(unnest(ps)) as low from x), "
    "o as (select *, [len(regexp_extract_all(low, '\\bturnover\\b')), len(regexp_extract_all(low, '\\bmargin\\b')), len(regexp_extract_all(low, '\\binvestors\\b'))] as occ from l), "
    "s as (select doc_id, ordinal, len(list_filter(occ, lambda x: x > 0)) as matched, cast(20 * len(list_filter(occ, lambda x: x > 0)) + 2 * list_sum(list_transform(occ, lambda x: least(x, 3))) + (case when contains(low, 'turnover margin investors') then 35 else 0 end) + least(greatest(coalesce(year(published_at) - 2018, 0), 0) * 3, 24) + (case when regexp_matches(low, '[0-9]') then 12 else 0 end) as integer) as score from o), "
    "r as (select *, row_number() over (partition by doc_id order by score desc, ordinal) as k from s where matched >= 2) select doc_id, ordinal, score from r where k <= 2 order by score desc, doc_id, ordinal limit 5",
    "d24_corpus_stats": f"with {_passages_sql('true')}, y as (select doc_id, count(*) as passages, sum(len(t)) as tokens from p group by 1) select company_slug, count(*) as documents, cast(sum(passages) as bigint) as passages, cast(sum(tokens) as bigint) as tokens, round(sum(tokens) / sum(passages), 1) as avg_tokens from documents left join y using (doc_id) group by 1",
}
