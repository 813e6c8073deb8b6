"""Readers. Each gives a DataFrame; what a file lacks or breaks is a null or a missing row, never an exception per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import text as T
from ..functions.dates import parse_date

KEYS = ("company", "ticker", "isin", "published_at", "document_type", "period", "source_url", "corpus_frozen_at")
SPEC = "companies array<struct<slug:string,company:string,ticker:string,period:string,outputFile:string,metrics:array<struct<label:string,units:string>>>>"
#: Fixed value: a catalog row.
CATALOG_ROW = r"(?m)^\|\s*([0-9]{4}-[0-9]{2}-[0-9]{2})\s*\|\s*([^|\n]+?)\s*\|\s*([^|\n]*?)\s*\|\s*([^|\n]+?)\s*\|\s*\[Open\]\(([^)\n]+)\)\s*\|"
#: Fixed value: a forecast row of a report page.
REPORT_ROW = r'<tr><td><strong>([A-Z:]+)</strong></td>\s*<td>([^<]+)</td>\s*<td class="num"><strong>([-0-9,.]+)</strong></td>\s*<td class="num">([-0-9,.]+)</td>\s*<td class="num">([-0-9,.]+)</td>\s*<td>([^<]*)</td>\s*<td><code>([^<]*)</code></td>'


def environment(path: str, override: bool = False) -> dict[str, str]:
    """KEY=VALUE lines of a file on the driver, put into the environment; what is set there already wins unless override."""
    import os

    try:
        with open(path, encoding="utf-8") as f:
            pairs = [x.split("=", 1) for x in map(str.strip, f) if "=" in x and not x.startswith(("#", "="))]
    except FileNotFoundError:
        return {}
    found = {k.strip(): v.strip().strip("\"'") for k, v in pairs}
    os.environ.update({k: v for k, v in found.items() if override or k not in os.environ})
    return found


def markdown_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, text) of every Markdown file below root but the catalogs, in whatever encoding errors they have."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    f = raw.select(path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("name"), F.col("value").alias("text"))
    return f.where(F.upper("name") != "INDEX.MD")


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """Documents of a Markdown corpus: front matter, title and body; a missing date falls back to the file name's."""
    f = markdown_files(spark, root)
    keys, body = T.front_matter(F.col("text"), KEYS)
    stem = F.regexp_replace("name", r"\.md$", "")
    day = F.coalesce(parse_date(keys["published_at"]), F.regexp_extract("name", r"^([0-9]{4}-[0-9]{2}-[0-9]{2})__", 1).try_cast("date"))
    return f.select(
        stem.alias("doc_id"), "path", keys["company"].alias("company"), keys["ticker"].alias("ticker"), day.alias("published_at"),
        F.upper(F.coalesce(keys["document_type"], F.lit("UNKNOWN"))).alias("document_type"), keys["period"].alias("period"), keys["source_url"].alias("source_url"),
        T.title(body, stem).alias("title"), body.alias("text"))


def filename_parts(name: Column) -> dict[str, Column]:
    """Parts of names such as 2031-02-03__abc-us-20310203-q4-8k__1000001.md; empty where a name is of another form."""
    p = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})__([a-z]+)(?:-([a-z]+))?-([0-9]{8})-(.*)__([0-9]+)\.md$"
    return {k: F.nullif(F.regexp_extract(F.lower(name), p, i + 1), F.lit("")) for i, k in enumerate(("published", "ticker", "market", "filed", "kind", "number"))}


def catalog(texts: DataFrame) -> DataFrame:
    """(published_at, document_type, period, title, rel_path, doc_id): rows of catalog texts(text); rows with a bad date are dropped."""
    cols = ("day", "document_type", "period", "title", "rel_path")
    rows = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(CATALOG_ROW), F.lit(i + 1)).alias(c) for i, c in enumerate(cols)])
    r = texts.select(F.explode(rows).alias("r")).select("r.*").withColumn("published_at", F.col("day").try_cast("date")).where("published_at is not null")
    return r.select("published_at", "document_type", "period", "title", "rel_path", F.regexp_extract("rel_path", r"([^/]+?)(?:\.md)?$", 1).alias("doc_id"))


def report_rows(pages: DataFrame) -> DataFrame:
    """(slug, metric, value, low, high, units, method): forecast rows of report pages(html)."""
    cols = ("slug", "metric", "value", "low", "high", "units", "method")
    rows = F.arrays_zip(*[F.regexp_extract_all("html", F.lit(REPORT_ROW), F.lit(i + 1)).alias(c) for i, c in enumerate(cols)])
    r = pages.select(F.explode(rows).alias("r")).select("r.*")
    number = lambda c: F.replace(F.col(c), F.lit(","), F.lit("")).try_cast("double").alias(c)
    return r.select("slug", unescape(F.col("metric")).alias("metric"), number("value"), number("low"), number("high"), unescape(F.col("units")).alias("units"), unescape(F.col("method")).alias("method"))


def unescape(c: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.trim(c)


def company_spec(spark: SparkSession, path: str) -> DataFrame:
    """(company, ticker, period, output_file, metric, units): one row per metric; a specification without companies or metrics is an error."""
    c = spark.read.schema(SPEC).json(path, multiLine=True).select(F.explode_outer("companies").alias("c"))
    bad = c.where(F.col("c").isNull() | F.col("c.metrics").isNull() | (F.size("c.metrics") < 1))
    if c.isEmpty() or not bad.isEmpty():
        raise ValueError(f"{path}: every specification needs companies and every company a metric")
    return c.select("c.company", "c.ticker", "c.period", F.col("c.outputFile").alias("output_file"), F.explode("c.metrics").alias("m")).select("company", "ticker", "period", "output_file", F.col("m.label").alias("metric"), F.col("m.units").alias("units"))


def resolve_folder(names: DataFrame, folders: DataFrame) -> DataFrame:
    """(name, folder): the folder whose slug is the longest leading part of the name's, or else the first that begins with it."""
    n = names.select("name", T.slugify(F.col("name")).alias("slug"))
    f = folders.select("folder", T.slugify(F.col("folder")).alias("fs"))
    # a folder that leads the name, or is led by its first word, begins with that word's first letters as far as it goes
    first = lambda c: F.split_part(c, F.lit("-"), F.lit(1))
    leads = n.select("name", "slug", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("slug"), F.lit(1))), lambda i: F.left("slug", i)))).alias("key")).join(f.select("folder", "fs", F.col("fs").alias("key")), "key")
    led = n.withColumn("key", first(F.col("slug"))).join(f.select("folder", "fs", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("fs"), F.lit(1))), lambda i: F.left("fs", i)))).alias("key")), "key")
    j = leads.select("name", "slug", "folder", "fs").unionByName(led.select("name", "slug", "folder", "fs")).distinct()
    lead = (F.col("slug") == F.col("fs")) | F.col("slug").startswith(F.concat("fs", F.lit("-")))
    return j.groupBy("name").agg(F.max_by("folder", F.struct(lead.cast("int"), F.when(lead, F.length("fs")).otherwise(0), F.col("folder"))).alias("folder"))


def snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON snapshot, empty where the file is missing or invalid."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path, multiLine=True)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def log_records(spark: SparkSession, path: str, schema: str, limit: int | None = 4000) -> DataFrame:
    """Records of an append-only JSON-lines log, invalid lines left out; with a limit, the last ones by seq."""
    try:
        d = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return d if limit is None else d.orderBy(F.desc("seq")).limit(limit).orderBy("seq")


def latest_runs(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Artifacts of the run written last: of all files that match, those of the newest run folder."""
    files = spark.read.format("binaryFile").load(glob).select("path", "modificationTime", F.regexp_extract("path", r"/(run-[^/]+)/", 1).alias("run"))
    newest = files.groupBy("run").agg(F.max("modificationTime").alias("t")).agg(F.max(F.struct("t", "run")).alias("s")).select("s.run")
    d = spark.read.schema(schema).json(glob, multiLine=True).withColumn("run", F.regexp_extract("_metadata.file_path", r"/(run-[^/]+)/", 1))
    return d.join(F.broadcast(newest), "run")  # one row


def forecasts(spark: SparkSession, per_company: str | None, combined: str | None = None) -> DataFrame:
    """(ticker, metric, value): forecasts of per-company files, else of the combined one; lists and envelopes alike."""
    item = "struct<ticker:string,metric:string,value:double>"
    parts = []
    for order, path in enumerate(p for p in (per_company, combined) if p):
        text = spark.read.text(path, wholetext=True)
        e = F.from_json("value", f"struct<companies:array<{item}>,forecasts:array<{item}>>")
        rows = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{item}>")).otherwise(F.coalesce(e["companies"], e["forecasts"]))
        parts.append(text.select(F.explode(rows).alias("r"), F.lit(order).alias("o")).select("r.*", "o").where("ticker is not null and metric is not null"))
    from ..operators.relational import first_per_key

    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return first_per_key(whole, ["ticker", "metric"], [F.asc("o"), F.asc_nulls_last("value")]).drop("o")
