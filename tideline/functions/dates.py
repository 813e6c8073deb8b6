"""Dates and moments written in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.common import strip

#: Date formats tried in order (fixed values).
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "d MMMM yyyy", "d MMM yyyy")


def midnight(d: Column) -> Column:
    """00:00 UTC of a date, whatever the session's zone."""
    return F.timestamp_micros(F.unix_date(d).cast("long") * 86_400_000_000)


def parse_date(c: Column) -> Column:
    """The date a text states, its time of day aside; null if it states none."""
    head = strip(F.split_part(c, F.lit("T"), F.lit(1)))
    return F.coalesce(*[F.try_to_timestamp(head, F.lit(f)).cast("date") for f in DATE_FORMATS])


def parse_moment(c: Column) -> Column:
    """The moment a text states: a date alone is 00:00 UTC, a time without zone is UTC; null if it states none."""
    s = strip(c)
    clock = s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{1,2}:\d{2}")
    zoned = F.when(s.rlike(r"(Z|z|[+-]\d{2}:?\d{2})$"), s).otherwise(F.concat(s, F.lit("Z")))
    return F.when(clock, zoned.try_cast("timestamp")).otherwise(midnight(parse_date(s)))
