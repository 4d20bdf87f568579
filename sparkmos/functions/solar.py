"""Solar position and daylight in closed form (the public NOAA solar equations).

Columns are added stage by stage, so that an intermediate such as the declination is
computed once per row. The formulas are SQL expression text: a long formula is then one
call into the JVM instead of one per operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmos.functions.common import micros
from sparkmos.functions.timefn import local
from sparkmos.settings import LOCAL_TZ

# Altitude of the sun's centre at sunrise: refraction plus half its disc.
SUNRISE_ZENITH = 90.8333
UNIX_EPOCH_JULIAN = 2440587.5


# Sine and cosine of degrees, for the formulas below.
def _s(x: str) -> str:
    return f"sin(radians({x}))"


def _c(x: str) -> str:
    return f"cos(radians({x}))"


def _sun_stages(julian_day: str, p: str) -> list[dict[str, str]]:
    """Steps to ``{p}decl`` (degrees) and ``{p}eot`` (equation of time, minutes)."""
    jc, l0, m, ecc, app, obl, y = (p + n for n in HELPERS)
    node = f"(125.04D - 1934.136D * {jc})"
    return [
        {jc: f"({julian_day} - 2451545D) / 36525D"},
        {
            l0: f"pmod(280.46646D + {jc} * (36000.76983D + {jc} * 0.0003032D), 360D)",
            m: f"357.52911D + {jc} * (35999.05029D - 0.0001537D * {jc})",
            ecc: f"0.016708634D - {jc} * (0.000042037D + 0.0000001267D * {jc})",
        },
        {
            app: f"{l0} + {_s(m)} * (1.914602D - {jc} * (0.004817D + 0.000014D * {jc}))"
            f" + {_s(f'2 * {m}')} * (0.019993D - 0.000101D * {jc}) + {_s(f'3 * {m}')} * 0.000289D"
            f" - 0.00569D - 0.00478D * {_s(node)}",
            obl: f"23D + (26D + (21.448D - {jc} * (46.815D + {jc} * (0.00059D - {jc} * 0.001813D))) / 60D) / 60D"
            f" + 0.00256D * {_c(node)}",
        },
        {y: f"pow(tan(radians({obl} / 2)), 2)", p + "decl": f"degrees(asin({_s(obl)} * {_s(app)}))"},
        {
            p + "eot": f"4 * degrees({y} * {_s(f'2 * {l0}')} - 2 * {ecc} * {_s(m)}"
            f" + 4 * {ecc} * {y} * {_s(m)} * {_c(f'2 * {l0}')} - 0.5D * {y} * {y} * {_s(f'4 * {l0}')}"
            f" - 1.25D * {ecc} * {ecc} * {_s(f'2 * {m}')})"
        },
    ]


HELPERS = ("jc", "l0", "m", "ecc", "app", "obl", "y")


def _with_sun(df: DataFrame, julian_days: dict[str, str]) -> DataFrame:
    """The sun at several moments per row, one prefix each, stage by stage together."""
    for stages in zip(*[_sun_stages(jd, p) for p, jd in julian_days.items()], strict=True):
        df = df.withColumns({name: F.expr(e) for stage in stages for name, e in stage.items()})
    return df.drop(*[p + n for p in julian_days for n in HELPERS])


def _half_day(lat: str, decl: str) -> str:
    """Hour angle of sunrise in degrees; NULL in polar day or night."""
    x = f"({_c(str(SUNRISE_ZENITH) + 'D')} / ({_c(lat)} * {_c(decl)}) - tan(radians({lat})) * tan(radians({decl})))"
    return f"CASE WHEN abs({x}) <= 1 THEN degrees(acos({x})) END"


# Refraction in degrees at an apparent elevation ``_el``.
_REFRACTION = """CASE WHEN _el > 85 THEN 0D
  WHEN _el > 5 THEN 58.1D / tan(radians(_el)) - 0.07D / pow(tan(radians(_el)), 3) + 0.000086D / pow(tan(radians(_el)), 5)
  WHEN _el > -0.575D THEN 1735D + _el * (-518.2D + _el * (103.4D + _el * (-12.79D + _el * 0.711D)))
  ELSE -20.772D / tan(radians(_el)) END / 3600D"""


def add_solar(df: DataFrame, time: str = "valid_time", lat: str = "lat", lon: str = "lon", tz: str = LOCAL_TZ) -> DataFrame:
    """Add elevation, azimuth, daylight flag, minutes since sunrise and until sunset, day length.

    Sunrise and sunset belong to the local calendar day and are NULL in polar day or night.
    """
    day0 = F.unix_date(local(time, tz).cast("date"))
    df = df.withColumns(
        {
            "_em": micros(time) / 60e6,  # minutes since the epoch
            "_d0": day0 + F.lit(0.0),  # local day, in days since the epoch
        }
    )
    df = _with_sun(
        df, {"_n_": f"(_em / 1440D + {UNIX_EPOCH_JULIAN}D)", "_d_": f"(_d0 + {UNIX_EPOCH_JULIAN + 0.5}D)"}
    )
    # Sunrise and sunset in minutes of the UTC day: first from noon, then refined once.
    half = f"4 * {_half_day(lat, '_d_decl')}"
    stages = [
        {
            "_ha": f"pmod(_em + _n_eot + 4 * {lon}, 1440D) / 4 - 180",
            "_rise0": f"720 - 4 * {lon} - _d_eot - {half}",
            "_set0": f"720 - 4 * {lon} - _d_eot + {half}",
        },
        {
            "_zen": f"degrees(acos(greatest(-1D, least(1D, {_s(lat)} * {_s('_n_decl')} + {_c(lat)} * {_c('_n_decl')} * {_c('_ha')}))))"
        },
        {
            "_el": "90 - _zen",
            "_angle": f"degrees(acos(greatest(-1D, least(1D, ({_s(lat)} * {_c('_zen')} - {_s('_n_decl')}) / ({_c(lat)} * {_s('_zen')})))))",
        },
        {
            "solar_elevation": f"_el + {_REFRACTION}",
            "solar_azimuth": "pmod(CASE WHEN _ha > 0 THEN _angle + 180 ELSE 540 - _angle END, 360D)",
        },
    ]
    for stage in stages:
        df = df.withColumns({name: F.expr(e) for name, e in stage.items()})
    df = _with_sun(
        df,
        {
            "_r_": f"(_d0 + {UNIX_EPOCH_JULIAN}D + _rise0 / 1440D)",
            "_s_": f"(_d0 + {UNIX_EPOCH_JULIAN}D + _set0 / 1440D)",
        },
    )
    stages = [
        {
            "_rise": f"720 - 4 * ({lon} + {_half_day(lat, '_r_decl')}) - _r_eot",
            "_set": f"720 - 4 * ({lon} - {_half_day(lat, '_s_decl')}) - _s_eot",
            "_t": "_em - _d0 * 1440",
        },
        {"solar_is_daytime": "coalesce(_t >= _rise AND _t <= _set, false)"},
        {
            "solar_minutes_since_sunrise": "CASE WHEN solar_is_daytime THEN _t - _rise END",
            "solar_minutes_until_sunset": "CASE WHEN solar_is_daytime THEN _set - _t END",
            "solar_day_length_min": "_set - _rise",
        },
    ]
    for stage in stages:
        df = df.withColumns({name: F.expr(e) for name, e in stage.items()})
    return df.drop(
        "_em", "_d0", "_t", "_ha", "_zen", "_el", "_angle", "_rise0", "_set0", "_rise", "_set",
        *[p + n for p in ("_n_", "_d_", "_r_", "_s_") for n in ("decl", "eot")],
    )
