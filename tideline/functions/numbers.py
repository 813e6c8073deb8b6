"""Numbers in text: parsing, conversion and the judgements about them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The parts of a number token.
_PARTS = r"(\()?[ \t]*([-−])?[ \t]*([$£€])?[ \t]*([-−])?([0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?)[ \t]*(\))?[ \t]*(billion\b|bn\b|million\b|mn\b|m\b|thousand\b|k\b)?[ \t]*(%|percentage points?\b|percent\b|bps\b|basis points?\b)?[ \t]*(pence\b|p\b)?"
NUMBER = "(?i)" + _PARTS
#: Factors to millions.
TO_MILLIONS = {"billion": 1000.0, "bn": 1000.0, "million": 1.0, "mn": 1.0, "m": 1.0, "thousand": 0.001, "k": 0.001}
#: Words that show which period a figure belongs to.
ANNUAL = ("fiscal year", "full year", "full-year", "twelve months", "twelve-month", "year ended", "year-to-date", "annual", "for the year")
QUARTERLY = ("quarter", "quarterly", "three months", "three-month", "q1", "q2", "q3", "q4")
#: Phrases of expectation and of report.
GUIDING = ("we are forecasting", "we expect", "we currently expect", "we anticipate", "is forecasted to be", "are forecasted to be", "we are planning for", "we are guiding", "guidance for", "outlook for", "expects to")
REPORTING = ("reported", "compared with", "compared to", "in the same period", "results for", "were $", "was $", "increased", "decreased")
MARKERS = ("we expect", "we are forecasting", "we anticipate", "guidance", "outlook", "is forecasted", "are forecasted", "we are guiding", "expects to", "targeting")


def parse(token: Column) -> Column:
    """struct(value, raw, currency, scale, is_percent, is_pence, negative) of one number token."""
    g = lambda k: F.nullif(F.regexp_extract(token, "^" + NUMBER, k), F.lit(""))
    negative = (g(1).isNotNull() & g(6).isNotNull()) | g(2).isNotNull() | g(4).isNotNull()
    size = F.regexp_replace(g(5), ",", "").try_cast("double")
    percent = F.lower(g(8))
    scale = F.when(percent.isin("bps", "basis point", "basis points"), "bps").otherwise(F.lower(g(7)))
    return F.struct(
        F.when(negative, -size).otherwise(size).alias("value"), F.trim(token).alias("raw"), g(3).alias("currency"), scale.alias("scale"),
        percent.isNotNull().alias("is_percent"), g(9).isNotNull().alias("is_pence"), negative.alias("negative"))


def parse_all(c: Column) -> Column:
    """Every number of a text, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0)), lambda t: parse(t))


def as_millions(n: Column) -> Column:
    factor = F.coalesce(F.create_map(*[F.lit(x) for kv in TO_MILLIONS.items() for x in kv])[n["scale"]], F.lit(1.0))
    return F.when(~n["is_percent"], n["value"] * factor)


def as_points(n: Column) -> Column:
    """Percentage points, basis points as hundredths; null for what is no percentage."""
    return F.when(n["is_percent"], F.when(n["scale"].eqNullSafe(F.lit("bps")), n["value"] / 100).otherwise(n["value"]))


def unit_kind(units: Column) -> Column:
    return F.when(units == "%", "percent").when(units.isin("USD / share", "EUR / share", "GBP / share", "GBp"), "per_share").when(units.isin("USDm", "GBPm", "EURm"), "money").otherwise("unknown")


def plausible(kind: Column, value: Column) -> Column:
    return F.when(kind == "percent", value.between(-100.0, 100.0)).when(kind == "per_share", (F.abs(value) > 0) & (F.abs(value) <= 500.0)).when(kind == "money", F.abs(value).between(1.0, 500_000.0)).otherwise(F.lit(True))


def any_of(c: Column, phrases: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(c, p))


def how_many_of(c: Column, phrases: tuple[str, ...]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(c, p)))


def wants_annual(period: Column) -> Column:
    return ~F.contains(F.regexp_replace(F.lower(period), "(?s)^(.*?)fy", "$1"), F.lit("q"))


def period_fit(context: Column, annual: Column) -> Column:
    """1.4 where the context names the wanted kind of period, 1 where it names none, null where it names only the other."""
    low = F.lower(context)
    years, quarters = how_many_of(low, ANNUAL), how_many_of(low, QUARTERLY)
    own, other = F.when(annual, years).otherwise(quarters), F.when(annual, quarters).otherwise(years)
    return F.when((other > 0) & (own == 0), None).when(own > 0, 1.4).otherwise(1.0)


def guiding_sentences(c: Column) -> Column:
    """Sentences that state an expectation and no result, in prose of moderate length."""
    parts = F.split(c, r"(?<=[.;])\s+|\n{2,}")
    digits = lambda s: F.length(F.regexp_replace(s, "[^0-9]", ""))
    bars = lambda s: F.length(s) - F.length(F.replace(s, F.lit("|")))
    ok = lambda s: any_of(F.lower(s), GUIDING) & ~any_of(F.lower(s), REPORTING) & (F.length(s) <= 420) & (bars(s) <= 2) & (digits(s) <= F.length(s) * 0.2)
    return F.filter(parts, ok)
