"""Instants in several notations, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLOCK = r"(?:[T ]+(\d{2}):?(\d{2}):?(\d{2})(?:[.,](\d{1,6})\d*)?)?"
_ZONE = r"\s*(Z|z|UTC|[+-]\d{2}:?\d{2}|[+-]\d{2})?"
YEAR_FIRST = r"^(\d{4})[-/.]?(\d{2})[-/.]?(\d{2})" + _CLOCK + _ZONE + "$"
DAY_FIRST = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})" + _CLOCK + _ZONE + "$"


def instant_micros(text: Column) -> Column:
    """Microseconds since the epoch of a date text, NULL if it can't be read.

    Year-month-day with or without separators, or day-month-year; an optional clock time; an optional
    offset, UTC without one. A date alone is its midnight.
    """
    s = F.trim(text)

    def built(pattern: str, y: int, m: int, d: int) -> Column:
        g = lambda i: F.regexp_extract(s, pattern, i)
        zone = g(8)
        minutes = F.when(F.length(zone) == 3, F.lit("00")).otherwise(F.regexp_extract(zone, r"(\d{2})$", 1))
        hours = F.when(zone.rlike("^[+-]"), F.concat(zone.substr(1, 3), F.lit(":"), minutes)).otherwise(F.lit("+00:00"))
        or_zero = lambda i: F.when(g(i) == "", F.lit("00")).otherwise(g(i))
        full = F.concat(
            g(y), F.lit("-"), F.lpad(g(m), 2, "0"), F.lit("-"), F.lpad(g(d), 2, "0"), F.lit(" "),
            or_zero(4), F.lit(":"), or_zero(5), F.lit(":"), or_zero(6), F.lit("."), F.rpad(g(7), 6, "0"), hours,
        )
        return F.when(s.rlike(pattern), full)

    whole = F.coalesce(built(YEAR_FIRST, 1, 2, 3), built(DAY_FIRST, 3, 2, 1))
    return F.unix_micros(whole.try_cast("timestamp"))
