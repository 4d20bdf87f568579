"""Weather codes and safety warnings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkmos.functions.common import lookup

# --- Fixed values: weather code -> (English, Italian, icon). ---
CODES = {
    0: ("Clear sky", "Cielo sereno", "☀️"),
    1: ("Mainly clear", "Prevalentemente sereno", "🌤️"),
    2: ("Partly cloudy", "Parzialmente nuvoloso", "⛅"),
    3: ("Overcast", "Coperto", "☁️"),
    45: ("Fog", "Nebbia", "🌫️"),
    48: ("Rime fog", "Nebbia con brina", "🌫️"),
    51: ("Light drizzle", "Pioviggine leggera", "🌦️"),
    53: ("Moderate drizzle", "Pioviggine moderata", "🌦️"),
    55: ("Dense drizzle", "Pioviggine densa", "🌧️"),
    56: ("Freezing drizzle", "Pioviggine gelata", "🌧️"),
    57: ("Dense freezing drizzle", "Pioviggine gelata densa", "🌧️"),
    61: ("Slight rain", "Pioggia leggera", "🌦️"),
    63: ("Moderate rain", "Pioggia moderata", "🌧️"),
    65: ("Heavy rain", "Pioggia battente", "🌧️"),
    66: ("Freezing rain", "Pioggia gelata", "🌧️"),
    67: ("Heavy freezing rain", "Pioggia gelata battente", "🌧️"),
    71: ("Slight snow", "Neve leggera", "🌨️"),
    73: ("Moderate snow", "Neve moderata", "🌨️"),
    75: ("Heavy snow", "Neve abbondante", "❄️"),
    77: ("Snow grains", "Granuli di neve", "🌨️"),
    80: ("Slight rain showers", "Rovesci leggeri", "🌦️"),
    81: ("Moderate rain showers", "Rovesci moderati", "🌧️"),
    82: ("Violent rain showers", "Rovesci violenti", "⛈️"),
    85: ("Slight snow showers", "Rovesci di neve leggeri", "🌨️"),
    86: ("Heavy snow showers", "Rovesci di neve abbondanti", "❄️"),
    95: ("Thunderstorm", "Temporale", "⛈️"),
    96: ("Thunderstorm with hail", "Temporale con grandine", "⛈️"),
    99: ("Severe thunderstorm with hail", "Temporale severo con grandine", "⛈️"),
}
UNKNOWN = ("Unknown", "❓")
WARNINGS = {
    "storm": "⛈️ Thunderstorm — seek shelter immediately",
    "snow": "❄️ Snow — freezing conditions, ice on deck risk",
    "fog": "🌫️ Fog — dangerous visibility, stay near shore",
    "rain": "🌧️ Heavy rain + strong wind — reduced visibility, difficult sailing",
}
# --- End of fixed values. ---


def description(code: Column, lang: str = "en") -> Column:
    i = 1 if lang == "it" else 0
    return lookup({k: v[i] for k, v in CODES.items()}, code, UNKNOWN[0])


def icon(code: Column) -> Column:
    return lookup({k: v[2] for k, v in CODES.items()}, code, UNKNOWN[1])


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_rainy(code: Column) -> Column:
    return _flag(code.between(51, 67) | code.between(80, 82))


def is_snowy(code: Column) -> Column:
    return _flag(code.between(71, 77) | code.between(85, 86))


def is_stormy(code: Column) -> Column:
    return _flag(code.between(95, 99))


def is_foggy(code: Column) -> Column:
    return _flag(code.isin(45, 48))


def sailing_warning(code: Column, wind_speed_kn: Column, visibility_m: Column) -> Column:
    return (
        F.when(is_stormy(code), F.lit(WARNINGS["storm"]))
        .when(is_snowy(code), F.lit(WARNINGS["snow"]))
        .when(is_foggy(code) | _flag(visibility_m < 1000), F.lit(WARNINGS["fog"]))
        .when(is_rainy(code) & (wind_speed_kn > 15), F.lit(WARNINGS["rain"]))
    )
