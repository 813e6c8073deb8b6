"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no search terms.
STOP_WORDS = (
    "a an and are as at be been but by for from has have how in into is it its of on or "
    "that the their there these this to was were what when which who will with"
).split()
#: Fixed value: a word token.
TOKEN = r"[a-z0-9][a-z0-9.'\-]*"
#: Invisible characters that are dropped, and the no-break space.
ZERO_WIDTH = "​﻿"
NBSP = " "
#: Shapes of credentials.
SECRETS = (
    r"sk-ant-[A-Za-z0-9_\-]{16,}",
    r"sk-[A-Za-z0-9_\-]{16,}",
    r"gh[pousr]_[A-Za-z0-9]{16,}",
    r"AKIA[0-9A-Z]{16}",
    r"(?i)\bbearer\s+[A-Za-z0-9._\-]{16,}",
    r"(?i)\bapi[_-]?key\s*[=:]\s*[A-Za-z0-9._\-]{16,}",
)
#: Fixed value: figures shown beside an excerpt.
FIGURE = r"(?i)(?<![\p{L}\p{N}_])(?:[$£€]\s*)?\(?-?\d(?:[\d,]*\d)?(?:\.\d+)?\)?(?:\s*(?:%|percent|million|billion|bn|m\b|pence|p\b|per\s+share))?"
#: Blanks that page extraction leaves inside numbers, before units and around hyphens, with what replaces them.
REPAIRS = ((r"(?<=\d)\s+(?=\.)|(?<=\.)\s+(?=\d)", ""), (r"(?<=\d)\s+(?=[\d.])", ""), (r"(?i)(?<=\d)\s+(?=(?:m|bn|million|billion)\b)", ""), (r"\s*-\s*(?=[A-Za-z])", "-"))


def normalise(c: Column) -> Column:
    """Without zero-width characters, no-break spaces as blanks."""
    return F.translate(c, NBSP + ZERO_WIDTH, " ")


def informative(c: Column, min_chars: int = 60, min_ratio: float = 0.30) -> Column:
    """Long enough, and dense enough in letters and digits, to be worth indexing."""
    return (F.length(c) >= min_chars) & (F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")) >= F.length(c) * F.lit(min_ratio))


def tokens(c: Column, stop: list[str] = STOP_WORDS, min_length: int = 2) -> Column:
    """Lower-cased word tokens in order, stop words and single characters left out."""
    found = F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))
    keep = (lambda t: (F.length(t) >= min_length) & ~t.isin(stop)) if stop else (lambda t: F.length(t) >= min_length)
    return F.filter(found, keep)


def figures(c: Column, limit: int = 12) -> Column:
    """The first distinct figures of a text, in order, of two characters or more."""
    found = F.transform(F.regexp_extract_all(c, F.lit(FIGURE), F.lit(0)), lambda x: F.btrim(x, F.lit(" \t\n\r")))
    return F.slice(F.array_distinct(F.filter(found, lambda x: F.length(x) >= 2)), 1, limit)


def repair_numbers(c: Column) -> Column:
    """Closes the blanks that page extraction leaves inside numbers, before their units and around hyphens."""
    for pattern, to in REPAIRS:
        c = F.regexp_replace(c, pattern, to)
    return c


def redact(c: Column, limit: int | None = None) -> Column:
    """Credentials masked; truncated to limit characters if one is given."""
    for pattern in SECRETS:
        c = F.regexp_replace(c, pattern, "[REDACTED]")
    return c if limit is None else F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("..."))).otherwise(c)


def truncate_head(c: Column, limit: int, mark: str = "\n[truncated]") -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit(mark))).otherwise(c)


def truncate_ends(c: Column, limit: int, mark: str = "\n[...]\n") -> Column:
    """The first nine tenths and the last tenth of limit characters."""
    head = limit * 9 // 10
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(head)), F.lit(mark), F.right(c, F.lit(limit - head)))).otherwise(c)


def excerpt(c: Column, phrase: str, width: int = 650) -> Column:
    """width characters of a text around the first place of a phrase, a quarter of them before it, marked where cut."""
    at = F.instr(F.lower(c), phrase.lower())
    start = F.greatest(F.lit(1), at - width // 4)
    return F.when(at > 0, F.concat(F.when(start > 1, F.lit("...")).otherwise(F.lit("")), F.substring(c, start, F.lit(width)), F.when(start + width - 1 < F.length(c), F.lit("...")).otherwise(F.lit(""))))


def front_matter(c: Column, keys: tuple[str, ...]) -> tuple[dict[str, Column], Column]:
    """The values of known keys of a leading block between `---` lines, decoded if they are JSON, and the text after the block."""
    block = F.nullif(F.regexp_extract(c, r"(?s)\A---\n(.*?\n)---\n", 1), F.lit(""))
    value = lambda k: F.regexp_extract(block, rf"(?m)^{k}:[ \t]*(.*?)[ \t]*$", 1)
    decoded = lambda v: F.from_json(F.concat(F.lit('{"v":'), v, F.lit("}")), "v string")["v"]
    plain = lambda k: F.nullif(F.when(value(k) != "null", F.coalesce(decoded(value(k)), value(k))), F.lit(""))
    body = F.when(block.isNull(), c).otherwise(F.regexp_replace(c, r"(?s)\A---\n.*?\n---\n", ""))
    return {k: plain(k) for k in keys}, body


def loose_front_matter(c: Column, keys: tuple[str, ...], head: int = 2048) -> dict[str, Column]:
    """The values of known keys of a block that lies within the first `head` characters, outer quotes removed; empty if absent."""
    block = F.regexp_extract(F.left(c, F.lit(head)), r"(?s)\A---\s*\n(.*?)\n---\s*\n", 1)
    return {k: F.regexp_extract(block, rf'(?m)^{k}:[ \t]*"?(.*?)"?[ \t\r]*$', 1) for k in keys}


def first_line(body: Column, most: int = 120) -> Column:
    """A leading `# ` heading, or else the start of the first line; blank lines and comments before it do not count."""
    line = F.get(F.filter(F.transform(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: (x != "") & ~x.startswith("<!--")), F.lit(0))
    return F.coalesce(F.when(line.startswith("# "), F.trim(F.substring(line, 3, 1_000_000))).otherwise(F.left(line, F.lit(most))), F.lit(""))


def title(body: Column, stem: Column) -> Column:
    """The first heading, else the file's stem."""
    return F.coalesce(F.nullif(F.regexp_extract(body, r"(?m)^#{1,4}[ \t]+(.*\S)[ \t]*$", 1), F.lit("")), stem)


def slugify(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), F.lit("-"))
