"""The point-in-time guard: documents are reached only through a cutoff date.

Corpus holds the documents and has no public handle on them; Corpus.as_of(date) gives a PointInTime whose relations are
already filtered, so an unguarded read cannot be written by accident. The cutoff is inclusive; strictly_before(date)
gives the day before. Unknown dates are blocked unless allowed. An independent audit re-checks a finished result.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import strip, table

BLOCKED_SAMPLES = 25


class LeakError(RuntimeError):
    """A result holds rows from after its cutoff."""


class NoCutoffError(RuntimeError):
    """Something asked for documents without a cutoff."""


def strictly_before(day: date) -> date:
    return day - timedelta(days=1)


def allowed(published: Column, as_of: date, allow_unknown: bool = False) -> Column:
    return F.coalesce(published <= F.lit(as_of), F.lit(allow_unknown))


class PointInTime:
    """What was known at the end of a day."""

    def __init__(self, documents: DataFrame, as_of: date, allow_unknown: bool = False, date_col: str = "published_at"):
        if as_of is None:
            raise NoCutoffError("a cutoff date is required")
        if isinstance(as_of, datetime):
            raise TypeError("the cutoff is a date, not a moment")
        self._all, self.cutoff, self.allow_unknown, self._date = documents, as_of, allow_unknown, date_col

    def documents(self) -> DataFrame:
        known = F.col(self._date) <= F.lit(self.cutoff)  # a bare comparison, which the scan can evaluate
        return self._all.where(known | F.col(self._date).isNull() if self.allow_unknown else known)

    def visible(self, company: str | None = None, types: tuple[str, ...] = (), newest_first: bool = True) -> DataFrame:
        """Documents of a company slug and of some types (both without regard to case), newest first, undated last."""
        d = self.documents()
        if company:
            d = d.where(F.upper("company_slug") == company.upper())
        if types:
            d = d.where(F.upper(strip("document_type")).isin([t.upper() for t in types]))
        return d.orderBy(F.desc_nulls_last(self._date), "doc_id") if newest_first else d

    def stats(self) -> DataFrame:
        """One row: how many documents were checked, allowed, blocked, and had no date."""
        ok, unknown = allowed(F.col(self._date), self.cutoff, self.allow_unknown), F.col(self._date).isNull()
        return self._all.agg(F.count("*").alias("checked"), F.count_if(ok).alias("allowed"), F.count_if(~ok).alias("blocked"), F.count_if(unknown).alias("unknown"))

    def blocked_sample(self, n: int = BLOCKED_SAMPLES) -> DataFrame:
        return self._all.where(~allowed(F.col(self._date), self.cutoff, self.allow_unknown)).orderBy("doc_id").limit(n)

    def leaks(self, result: DataFrame) -> DataFrame:
        """Rows of a finished result that this cutoff does not allow."""
        return result.where(~allowed(F.col(self._date), self.cutoff, self.allow_unknown))

    def audit(self, result: DataFrame) -> None:
        if n := self.leaks(result).count():
            raise LeakError(f"{n} rows are from after {self.cutoff}")


class Corpus:
    """Documents that can only be read as of a date."""

    def __init__(self, documents: DataFrame):
        self.__documents = documents

    @classmethod
    def load(cls, spark: SparkSession, sf_dir: str) -> Corpus:
        return cls(table(spark, sf_dir, "documents"))

    def as_of(self, day: date, allow_unknown: bool = False) -> PointInTime:
        return PointInTime(self.__documents, day, allow_unknown)


def find(documents: DataFrame, before: date, after: date | None = None, ticker: str | None = None, kinds: tuple[str, ...] = (), period: str | None = None) -> DataFrame:
    """Metadata filter with an exclusive upper bound: any of the kinds in the path, period as part of the period."""
    d = documents.where(F.col("published_at") < F.lit(before))
    if after:
        d = d.where(F.col("published_at") >= F.lit(after))
    if ticker:
        d = d.where(F.upper("ticker") == ticker.upper())
    if kinds:
        d = d.where(F.exists(F.array(*[F.lit(k) for k in kinds]), lambda k: F.contains(F.lower("rel_path"), k)))
    if period:
        d = d.where(F.contains(F.upper("period"), F.lit(period.upper())))
    return d


def catalog(documents: DataFrame, as_of: date, since: date | None = None, text: str | None = None, limit: int = 25) -> DataFrame:
    """The newest entries up to the cutoff whose period or title holds a text."""
    d = documents.where(F.col("published_at") <= F.lit(as_of))
    if since:
        d = d.where(F.col("published_at") >= F.lit(since))
    if text:
        d = d.where(F.contains(F.lower(F.coalesce("period", F.lit(""))), F.lit(text.lower())) | F.contains(F.lower("title"), F.lit(text.lower())))
    return d.orderBy(F.desc("published_at"), "doc_id").limit(limit)


def slug_period(path: Column) -> Column:
    """The period a file name states, Q1 to Q4, FY, H1 or H2; null if none."""
    return F.upper(F.nullif(F.regexp_extract(F.lower(path), r"-(q[1-4]|fy|h[12])-", 1), F.lit("")))


def period_conflict(label: Column, path: Column) -> Column:
    """The file name states a quarter that the period label does not hold."""
    slug = slug_period(path)
    return F.coalesce(slug.startswith("Q") & ~F.contains(F.upper(F.replace(F.coalesce(label, F.lit("")), F.lit(" "))), slug), F.lit(False))


CUTOFF = date(2025, 6, 30)


def _pit(spark, sf_dir) -> PointInTime:
    return Corpus.load(spark, sf_dir).as_of(CUTOFF)


def c1_guard_filter(spark, sf_dir):
    return _pit(spark, sf_dir).documents().select("doc_id", "published_at")


def c1_guard_stats(spark, sf_dir):
    return _pit(spark, sf_dir).stats()


def c1_blocked_sample(spark, sf_dir):
    return _pit(spark, sf_dir).blocked_sample().select("doc_id", "published_at")


def c2_strictly_before(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.date_sub("published_at", 1).alias("cutoff")).where("cutoff is not null")


def c5_leak_audit(spark, sf_dir):
    """Leaks of a result that was made under the guard, and of one that was not."""
    p, d = _pit(spark, sf_dir), table(spark, sf_dir, "documents")
    guarded = p.leaks(p.visible("wexhollow-stores")).agg(F.count("*").alias("leaks")).select(F.lit("guarded").alias("result"), "leaks")
    return guarded.unionByName(p.leaks(d).agg(F.count("*").alias("leaks")).select(F.lit("unguarded").alias("result"), "leaks"))


def c6_visible(spark, sf_dir):
    v = _pit(spark, sf_dir).visible("wexhollow-stores", ("FILING", "SLIDE"), newest_first=False)
    return v.select("doc_id", "published_at", F.upper(strip("document_type")).alias("document_type"))


def c7_point_lookup(spark, sf_dir):
    return _pit(spark, sf_dir).documents().where("doc_id in (100001, 100002, 100005, 100010)").select("doc_id", "title")


def c8_catalog(spark, sf_dir):
    return catalog(table(spark, sf_dir, "documents"), CUTOFF, date(2024, 1, 1), "q2").select("doc_id", "published_at", "period")


def c9_find(spark, sf_dir):
    return find(table(spark, sf_dir, "documents"), CUTOFF, date(2023, 7, 1), kinds=("8k", "deck"), period="Q2").select("doc_id", "published_at")


def c11_filing_kind(spark, sf_dir):
    """The first of 8k, 10q, 10k in the file name, else other."""
    kind = F.coalesce(*[F.when(F.contains(F.lower("rel_path"), F.lit(f"-{k}")), k) for k in ("8k", "10q", "10k")], F.lit("other"))
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("filing_kind"))


def c12_period_conflict(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", slug_period(F.col("rel_path")).alias("slug_period"), period_conflict(F.col("period"), F.col("rel_path")).alias("conflict"))


def c18_blocked_host(spark, sf_dir, blocked: tuple[str, ...] = ("wexhollow-stores.example", "open")):
    """Documents whose source's host holds a blocked name; an address that does not parse is searched whole."""
    host = F.lower(F.coalesce(F.try_parse_url("source_url", F.lit("HOST")), "source_url"))
    d = table(spark, sf_dir, "documents").where("source_url is not null")
    return d.select("doc_id", host.alias("host"), F.exists(F.array(*[F.lit(b) for b in blocked]), lambda b: F.contains(host, b)).alias("blocked"))


def d10_latest(spark, sf_dir):
    """The newest document of each company and type at the cutoff."""
    v = _pit(spark, sf_dir).documents()
    return v.groupBy("company_slug", F.upper(strip("document_type")).alias("document_type")).agg(F.max(F.struct("published_at", "doc_id")).alias("s")).select("company_slug", "document_type", "s.published_at", "s.doc_id")


QUERIES = {f.__name__: f for f in (c1_guard_filter, c1_guard_stats, c1_blocked_sample, c2_strictly_before, c5_leak_audit, c6_visible, c7_point_lookup, c8_catalog, c9_find, c11_filing_kind, c12_period_conflict, c18_blocked_host, d10_latest)}
_OK = "published_at <= date '2025-06-30'"
_TYPE = "upper(trim(document_type, ' ' || chr(9) || chr(10) || chr(13) || chr(160)))"
_SLUG = "upper(nullif(regexp_extract(lower(rel_path), '-(q[1-4]|fy|h[12])-', 1), ''))"
ORACLES = {
    "c1_guard_filter": f"select doc_id, published_at from documents where {_OK}",
    "c1_guard_stats": f"select count(*) as checked, count(*) filter ({_OK}) as allowed, count(*) filter (coalesce(not ({_OK}), true)) as blocked, count(*) filter (published_at is null) as unknown from documents",
    "c1_blocked_sample": f"select doc_id, published_at from documents where coalesce(not ({_OK}), true) order by doc_id limit 25",
    "c2_strictly_before": "select doc_id, published_at - 1 as cutoff from documents where published_at is not null",
    "c5_leak_audit": f"select 'guarded' as result, 0::bigint as leaks union all select 'unguarded', count(*) from documents where coalesce(not ({_OK}), true)",
    "c6_visible": f"select doc_id, published_at, {_TYPE} as document_type from documents where {_OK} and company_slug = 'wexhollow-stores' and {_TYPE} in ('FILING', 'SLIDE')",
    "c7_point_lookup": f"select doc_id, title from documents where {_OK} and doc_id in (100001, 100002, 100005, 100010)",
    "c8_catalog": f"select doc_id, published_at, period from documents where {_OK} and published_at >= date '2024-01-01' and (lower(coalesce(period, '')) like '%q2%' or lower(title) like '%q2%') order by published_at desc, doc_id limit 25",
    "c9_find": "select doc_id, published_at from documents where published_at < date '2025-06-30' and published_at >= date '2023-07-01' and (lower(rel_path) like '%8k%' or lower(rel_path) like '%deck%') and upper(period) like '%Q2%'",
    "c11_filing_kind": "select doc_id, case when lower(rel_path) like '%-8k%' then '8k' when lower(rel_path) like '%-10q%' then '10q' when lower(rel_path) like '%-10k%' then '10k' else 'other' end as filing_kind from documents",
    "c12_period_conflict": f"select doc_id, {_SLUG} as slug_period, coalesce({_SLUG} like 'Q%' and not contains(upper(replace(coalesce(period, ''), ' ', '')), {_SLUG}), false) as conflict from documents",
    "c18_blocked_host": "select doc_id, lower(regexp_extract(source_url, '^[a-z]+://([^/:]+)', 1)) as host, contains(lower(regexp_extract(source_url, '^[a-z]+://([^/:]+)', 1)), 'wexhollow-stores.example') or contains(lower(regexp_extract(source_url, '^[a-z]+://([^/:]+)', 1)), 'open') as blocked from documents where source_url is not null",
    "d10_latest": f"select company_slug, document_type, published_at, doc_id from (select company_slug, {_TYPE} as document_type, published_at, doc_id, row_number() over (partition by company_slug, {_TYPE} order by published_at desc, doc_id desc) as n from documents where {_OK}) where n = 1",
}
