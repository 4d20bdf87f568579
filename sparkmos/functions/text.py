"""Numbers, units and directions out of station page text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: names of directions and their degrees (NULL: variable wind). ---
CARDINAL_DEG = {
    "N": 0.0, "NNE": 22.5, "NE": 45.0, "ENE": 67.5,
    "E": 90.0, "ESE": 112.5, "SE": 135.0, "SSE": 157.5,
    "S": 180.0, "SSW": 202.5, "SW": 225.0, "WSW": 247.5,
    "W": 270.0, "WNW": 292.5, "NW": 315.0, "NNW": 337.5,
    "NNE-NE": 33.75, "VARIABILE": None, "VARIABILI": None, "V": None,
}
NUMBER_UNIT = r"(-?[0-9]+(?:[.,][0-9]+)?)\s*([a-zA-Z°/%²]+)?"
# --- End of fixed values. ---


def to_number(text: Column) -> Column:
    """Decimal comma or point to a double, NULL when it is not a number."""
    cleaned = F.trim(F.replace(F.replace(text, F.lit(","), F.lit(".")), F.lit("\u00a0"), F.lit("")))
    return cleaned.try_cast("double")


def number_in(text: Column) -> Column:
    """First number in a text such as '11 km/h'."""
    plain = F.replace(text, F.lit("\u00a0"), F.lit(" "))
    return to_number(F.nullif(F.regexp_extract(plain, NUMBER_UNIT, 1), F.lit("")))


def unit_in(text: Column) -> Column:
    plain = F.replace(text, F.lit("\u00a0"), F.lit(" "))
    return F.nullif(F.lower(F.regexp_extract(plain, NUMBER_UNIT, 2)), F.lit(""))


def cardinal_deg(text: Column) -> Column:
    """Degrees of a direction name: exact, else the longest name contained, else 'nn°'."""
    s = F.trim(F.upper(text))
    names = list(CARDINAL_DEG)

    def deg(name: str) -> Column:
        return F.lit(CARDINAL_DEG[name]).cast("double")

    expr = F.when(s.isNull() | (s == ""), F.lit(None).cast("double"))
    for name in names:
        expr = expr.when(s == name, deg(name))
    for name in sorted(names, key=len, reverse=True):
        expr = expr.when(s.contains(name), deg(name))
    numeric = F.regexp_extract(s, r"(\d{1,3})\s*[°º]", 1)
    return expr.when(numeric != "", F.pmod(numeric.try_cast("double"), F.lit(360.0)))
