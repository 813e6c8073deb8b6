"""Queries of the parsers, on texts made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.common import table
from . import readers as R


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def a6_catalog(spark, sf_dir):
    """Catalog texts of at most 500 of a company's documents each, parsed again."""
    row = F.concat(F.lit("| "), F.coalesce(F.col("published_at").cast("string"), F.lit("n/a")), F.lit(" | "), F.coalesce("document_type", F.lit("-")), F.lit(" | "), F.coalesce("period", F.lit("")), F.lit(" | "), F.col("title"), F.lit(" | [Open]("), F.col("rel_path"), F.lit(") |"))
    t = _docs(spark, sf_dir).where("company_slug is not null").groupBy("company_slug", F.floor(F.col("doc_id") / 500)).agg(F.concat_ws("\n", F.collect_list(row)).alias("text"))
    return R.catalog(t).select("published_at", "title", "doc_id")


def a10_report_rows(spark, sf_dir):
    """Report pages of at most 500 of a metric's anchors each, scraped again."""
    a = table(spark, sf_dir, "guidance_anchors").select("anchor_id", "ticker", "metric", "value", "units").distinct()
    v = F.format_number("value", 2)
    row = F.concat(F.lit("<tr><td><strong>"), F.col("ticker"), F.lit("</strong></td><td>P&amp;L "), F.col("metric"), F.lit('</td><td class="num"><strong>'), v, F.lit('</strong></td><td class="num">'), v, F.lit('</td><td class="num">'), v, F.lit("</td><td>"), F.col("units"), F.lit("</td><td><code>m"), F.col("anchor_id"), F.lit("</code></td></tr>"))
    pages = a.groupBy("metric", F.floor(F.col("anchor_id") / 500)).agg(F.concat_ws("\n", F.collect_list(row)).alias("html"))
    return R.report_rows(pages).select("slug", "metric", F.round("value", 2).alias("value"), "units", "method")


def a15_folders(spark, sf_dir):
    """Companies resolved to the folders their documents lie in."""
    names = table(spark, sf_dir, "company_metrics").select(F.col("company").alias("name")).distinct()
    folders = _docs(spark, sf_dir).select(F.split_part("rel_path", F.lit("/"), F.lit(2)).alias("folder")).distinct()
    return R.resolve_folder(names, folders)


def a2c_filename(spark, sf_dir):
    name = F.element_at(F.split("rel_path", "/"), -1)
    return _docs(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in R.filename_parts(name).items()])


def c21_company_lookup(spark, sf_dir, asked: tuple[str, ...] = ("wexw", "Torgard CHAMBERS", "XSE:OSTH", "nobody")):
    """Names as asked, resolved by ticker, ticker without exchange, or company name."""
    q = spark.createDataFrame([(a,) for a in asked], "asked string").withColumn("k", F.lower(F.element_at(F.split("asked", ":"), -1)))
    c = table(spark, sf_dir, "company_metrics").select("company", "ticker").distinct()
    keys = c.select("company", F.explode(F.array(F.lower("ticker"), F.lower("company"))).alias("k"))
    return q.join(keys, "k", "left").select("asked", "company")


QUERIES = {f.__name__: f for f in (a6_catalog, a10_report_rows, a15_folders, a2c_filename, c21_company_lookup)}
_F = "regexp_extract(lower(split_part(rel_path, '/', -1)), '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})__([a-z]+)(?:-([a-z]+))?-([0-9]{{8}})-(.*)__([0-9]+)\\.md$', {k})"
ORACLES = {
    "a6_catalog": "select published_at, title, regexp_extract(rel_path, '([^/]+?)\\.md$', 1) as doc_id from documents where company_slug is not null and published_at is not null and title is not null",
    "a10_report_rows": "select distinct ticker as slug, 'P&L ' || metric as metric, round(value, 2) as value, units, 'm' || anchor_id as method from guidance_anchors where value is not null and units is not null",
    "a15_folders": "select distinct company as name, trim(regexp_replace(lower(company), '[^a-z0-9]+', '-', 'g'), '-') as folder from company_metrics where trim(regexp_replace(lower(company), '[^a-z0-9]+', '-', 'g'), '-') in (select split_part(rel_path, '/', 2) from documents)",
    "a2c_filename": "select doc_id, " + ", ".join(f"nullif({_F.format(k=i + 1)}, '') as {k}" for i, k in enumerate(("published", "ticker", "market", "filed", "kind", "number"))) + " from documents",
    "c21_company_lookup": "with q as (select unnest(['wexw', 'Torgard CHAMBERS', 'XSE:OSTH', 'nobody']) as asked) select asked, (select min(company) from company_metrics where lower(ticker) = lower(split_part(asked, ':', -1)) or lower(company) = lower(split_part(asked, ':', -1))) as company from q",
}
