"""Local time, calendar features, time-of-day windows, quiet hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkmos.functions.common import col
from sparkmos.settings import LOCAL_TZ

# --- Fixed values: time-of-day windows in local time, both ends included. ---
WINDOWS = {
    "tivano_dying": ("08:30", "09:30"),
    "breva_building": ("10:30", "11:00"),
    "breva_window": ("10:00", "18:00"),
    "tivano_window": ("04:00", "09:30"),
}
# --- End of fixed values. ---


def local(utc: Column | str, tz: Column | str = LOCAL_TZ) -> Column:
    """Zone-less UTC to zone-less local time, daylight saving included."""
    zone = F.lit(tz) if isinstance(tz, str) else tz
    return F.convert_timezone(F.lit("UTC"), zone, col(utc))


def to_utc(local_time: Column | str, tz: Column | str = LOCAL_TZ) -> Column:
    zone = F.lit(tz) if isinstance(tz, str) else tz
    return F.convert_timezone(zone, F.lit("UTC"), col(local_time))


def hhmm(local_time: Column) -> Column:
    return F.date_format(local_time, "HH:mm")


def window_flags(local_time: Column) -> dict[str, Column]:
    clock = hhmm(local_time)
    return {name: clock.between(lo, hi) for name, (lo, hi) in WINDOWS.items()}


def season(month: Column) -> Column:
    """December to February is 0, then 1 to 3."""
    return F.floor(F.pmod(month, F.lit(12)) / 3).cast("int")


def calendar(local_time: Column) -> dict[str, Column]:
    return {
        "hour_local": F.hour(local_time),
        "day_of_year": F.dayofyear(local_time),
        "month": F.month(local_time),
        "season": season(F.month(local_time)),
        "is_weekend": F.weekday(local_time) >= 5,
    }


def minute_of_day(local_time: Column) -> Column:
    return F.hour(local_time) * 60 + F.minute(local_time)


def clock_minutes(text: Column) -> Column:
    """Minutes since midnight of an HH:MM string."""
    parts = F.split(text, ":")
    return F.get(parts, F.lit(0)).cast("int") * 60 + F.get(parts, F.lit(1)).cast("int")


def in_quiet_hours(local_time: Column, start: Column, end: Column) -> Column:
    now, lo, hi = minute_of_day(local_time), clock_minutes(start), clock_minutes(end)
    return F.when(lo <= hi, now.between(lo, hi)).otherwise((now >= lo) | (now <= hi))


def subscription_due(local_now: Column, local_time: Column, last_sent: Column, tolerance_min: int = 30) -> Column:
    """Within the tolerance of the wanted clock time, and not sent on this local day."""
    near = F.abs(minute_of_day(local_now) - clock_minutes(local_time)) <= tolerance_min
    sent_today = F.coalesce(last_sent.cast("date") == local_now.cast("date"), F.lit(False))
    return near & ~sent_today
