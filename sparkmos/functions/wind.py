"""Wind vectors, direction arithmetic, units and names of directions.

Directions are meteorological: degrees clockwise from north, where the wind comes from.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkmos.functions.common import lookup, pick, rnd

# --- Fixed values: unit factors, direction names, Beaufort scale. ---
KN_TO_MS = 0.514444
KN_TO_KMH = 1.852
KMH_TO_KN = 0.539957
MS_TO_KN = 1.94384
NAMES_16 = [
    "N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE",
    "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW",
]
NAMES_8 = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
BEAUFORT_KN = [0, 1, 4, 7, 11, 17, 22, 28, 35, 42, 50, 59, 68]
# --- End of fixed values. ---


def u_of(speed: Column, direction: Column) -> Column:
    return -speed * F.sin(F.radians(direction))


def v_of(speed: Column, direction: Column) -> Column:
    return -speed * F.cos(F.radians(direction))


def speed_of(u: Column, v: Column) -> Column:
    s = F.hypot(u, v)
    return F.when(s < 1e-6, F.lit(0.0)).otherwise(s)


def direction_of(u: Column, v: Column) -> Column:
    deg = F.pmod(F.degrees(F.atan2(-u, -v)) + 360.0, F.lit(360.0))
    return F.when(F.hypot(u, v) < 1e-6, F.lit(0.0)).otherwise(deg)


def direction_error(predicted: Column, observed: Column) -> Column:
    """Smallest angle between two directions, 0 to 180."""
    return F.abs(F.pmod(predicted - observed + 180.0, F.lit(360.0)) - 180.0)


def corrected_speed(fu: Column, fv: Column, bu: Column, bv: Column) -> Column:
    return speed_of(fu + bu, fv + bv)


def corrected_direction(fu: Column, fv: Column, bu: Column, bv: Column) -> Column:
    return direction_of(fu + bu, fv + bv)


def circular_mean(sum_sin: Column, sum_cos: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(sum_sin, sum_cos)) + 360.0, F.lit(360.0))


def circular_variance(sum_sin: Column, sum_cos: Column, n: Column) -> Column:
    return 1.0 - F.hypot(sum_sin, sum_cos) / n


def kmh_to_kn(c: Column) -> Column:
    return rnd(c * KMH_TO_KN, 3)


def ms_to_kn(c: Column) -> Column:
    return rnd(c * MS_TO_KN, 2)


def in_units(speed_kn: Column, units: Column) -> Column:
    return (
        F.when(units == "ms", speed_kn * KN_TO_MS)
        .when(units == "kmh", speed_kn * KN_TO_KMH)
        .otherwise(speed_kn)
    )


def unit_label(units: Column) -> Column:
    return F.when(units == "ms", F.lit("m/s")).when(units == "kmh", F.lit("km/h")).otherwise(F.lit("kn"))


def name_16(direction: Column, mode: str = "floor") -> Column:
    """16-way name. ``floor`` is the text interface's rule, ``round`` the web page's."""
    if mode == "floor":
        step = F.floor(F.pmod(direction, F.lit(360.0)) / 22.5)
    elif mode == "round":
        step = F.floor(direction / 22.5 + 0.5)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return pick(NAMES_16, F.pmod(step, F.lit(16)).cast("int"))


def name_8(direction: Column) -> Column:
    step = F.floor(F.pmod(direction + 22.5, F.lit(360.0)) / 45.0)
    return pick(NAMES_8, F.pmod(step, F.lit(8)).cast("int"))


def beaufort_to_kn(force: Column) -> Column:
    return F.get(F.array(*[F.lit(float(x)) for x in BEAUFORT_KN]), F.least(force, F.lit(12)).cast("int"))


def name_8_to_deg(name: Column) -> Column:
    return lookup({n: 45.0 * i for i, n in enumerate(NAMES_8)}, F.upper(name))
