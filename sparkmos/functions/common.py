"""Small expression helpers shared by the other modules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_MINUTE = 60_000_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: Column, digits: int) -> Column:
    """Half-up rounding that does not depend on noise in the last bits.

    Sums computed in another order differ by an ulp or two; rounding to nine digits
    first keeps a tie on the same side whatever the partitioning was.
    """
    return F.round(F.round(c, 9), digits)


def clamp(c: Column, lo: float, hi: float) -> Column:
    """Limit to [lo, hi]; NULL stays NULL (greatest/least would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch of a zone-less UTC timestamp."""
    return F.unix_micros(col(c).cast("timestamp"))


def minute_index(c: Column | str) -> Column:
    """Whole minutes since the epoch (floor, also before 1970)."""
    return F.floor(F.unix_seconds(col(c).cast("timestamp")) / 60)


def hour_index(c: Column | str) -> Column:
    return F.floor(F.unix_seconds(col(c).cast("timestamp")) / 3600)


def trunc_ntz(unit: str, c: Column | str) -> Column:
    return F.date_trunc(unit, col(c)).cast("timestamp_ntz")


def minutes_ago(c: Column | str, minutes: Column | int) -> Column:
    return col(c) - F.make_dt_interval(mins=F.lit(minutes) if isinstance(minutes, int) else minutes)


def ts(value: str) -> Column:
    """Zone-less timestamp literal."""
    return F.lit(value).cast("timestamp_ntz")


def iso_time(text: Column | str) -> Column:
    """ISO text to a zone-less time; an offset is dropped, unreadable text gives NULL."""
    return F.regexp_replace(col(text), r"(?:Z|[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz")


def mean_of_present(*cols: Column, at_least: int = 1) -> Column:
    """Mean of the non-NULL arguments, NULL when fewer than ``at_least`` are present."""
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    return F.when(n >= at_least, total / n)


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """Value for ``key`` in a literal map, or ``default``."""
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    found = F.try_element_at(F.create_map(*entries), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def pick(items: list[str], zero_based: Column) -> Column:
    """Element of a literal list at a zero-based index."""
    return F.get(F.array(*[F.lit(x) for x in items]), zero_based)
