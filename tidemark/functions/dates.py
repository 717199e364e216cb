"""Date windows and epochs."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of a window, their spellings and seconds.
UNITS = {"hours": ("h hr hrs hour hours", 3600), "days": ("d day days", 86400), "weeks": ("w wk wks week weeks", 604800), "months": ("m mo mon month months", 2592000)}
SPELLED = {word: (unit, seconds) for unit, (words, seconds) in UNITS.items() for word in words.split()}


@dataclass(frozen=True)
class Window:
    n: int
    unit: str
    seconds: int


def posted_window(value: str | None) -> Window | None:
    """'last_24h', '7 days', 'past-week'. None if it says nothing."""
    m = re.fullmatch(r"(?:(?:last|past)[\s_-]+)?(\d*)[\s_-]*([a-z]+)", str(value or "").strip().lower())
    n = int(m[1] or 1) if m else 0
    if not n or m[2] not in SPELLED:
        return None
    unit, seconds = SPELLED[m[2]]
    return Window(n, unit, n * seconds)


def from_epoch(c: Column) -> Column:
    """Seconds or milliseconds, told apart by size."""
    n = c.cast("long")
    return F.timestamp_seconds(F.when(n >= 100_000_000_000, n / 1000).otherwise(n))


def epoch(c: Column) -> Column:
    return F.unix_timestamp(c.cast("timestamp"))


def changes(type_was: Column, date_was: Column, type_is: Column, date_is: Column, as_of: Column, old_days: int = 180) -> Column:
    """struct of what a reading changes on a stored row: its type, its date, and whether it is old now and was not before."""
    since = as_of - F.make_interval(days=F.lit(old_days))
    return F.struct(
        (type_is.isNotNull() & ~type_is.eqNullSafe(type_was)).alias("type_changed"),
        (date_is.isNotNull() & ~date_is.eqNullSafe(date_was)).alias("date_changed"),
        F.coalesce((date_is < since) & (date_was.isNull() | (date_was >= since)), F.lit(False)).alias("now_old"),
    )
