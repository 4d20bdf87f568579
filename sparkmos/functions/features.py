"""Feature formulas over columns that are already joined to the sample."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkmos import settings as cfg
from sparkmos.functions.common import clamp, mean_of_present, rnd


def agreement(models=cfg.MODELS) -> dict[str, Column]:
    """Absolute differences of every pair of models, NULL when either is missing."""
    out: dict[str, Column] = {}
    for a, b in combinations(models, 2):
        for field, short in (("speed", "speed"), ("pressure", "press"), ("temp", "temp")):
            out[f"agree_{short}_{a}_{b}"] = F.expr(f"abs(fc_{a}_{field} - fc_{b}_{field})")
        out[f"agree_dir_{a}_{b}"] = F.expr(f"abs(pmod(fc_{a}_dir - fc_{b}_dir + 180, 360D) - 180)")
    return out


def foehn_flags(gradient: Column) -> dict[str, Column]:
    return {
        "foehn_pressure_gradient": gradient,
        "foehn_likely": F.coalesce(gradient >= cfg.FOEHN_LIKELY_HPA, F.lit(False)),
        "foehn_strong": F.coalesce(gradient >= cfg.FOEHN_STRONG_HPA, F.lit(False)),
    }


def pressure_gradients(anchor: dict[str, Column]) -> dict[str, Column]:
    return {
        f"pressure_grad_{name}": rnd(anchor[a] - anchor[b], 2) for name, (a, b) in cfg.ANCHOR_GRADIENTS.items()
    }


def thermal_inertia(mean_temp: Column, newest: Column, oldest: Column, n: Column, solar: Column) -> dict[str, Column]:
    """From the temperatures of the last hours: mean, trend per step, accumulated sun, index."""
    trend = (newest - oldest) / F.greatest(n - 1, F.lit(1))
    solar = F.when(mean_temp.isNotNull(), F.coalesce(solar, F.lit(0.0)))
    index = (
        0.5 * F.least(F.lit(1.0), solar / 3000.0)
        + 0.2 * clamp((trend + 2.0) / 4.0, 0.0, 1.0)
        + 0.3 * clamp((mean_temp - 5.0) / 30.0, 0.0, 1.0)
    )
    return {
        "thermal_inertia_avg_temp": rnd(mean_temp, 2),
        "thermal_inertia_temp_trend": rnd(trend, 4),
        "thermal_inertia_solar_accum": rnd(solar, 1),
        "thermal_inertia_index": rnd(F.when(mean_temp.isNotNull(), index), 4),
    }


def stability(cape: Column, blh: Column, speed: Column, gust: Column, temp: Column, dew: Column, is_day: Column) -> dict[str, Column]:
    lifted = -cape / 100.0
    shear = gust - speed
    score = (
        F.when(cape.isNotNull(), clamp(0.5 - lifted / 20.0, 0.0, 1.0))
        .when(blh.isNotNull(), clamp((blh - 500.0) / 1500.0, 0.0, 1.0))
        .otherwise(F.lit(0.5))
    )
    convective = F.coalesce((cape > 1000) & (score > 0.6) & is_day, F.lit(False))
    return {
        "cape_instability_proxy": rnd(lifted, 2),
        "surface_shear_proxy": rnd(F.when(shear > 0.1, cape / (0.5 * shear * shear)), 2),
        "stability_score": rnd(score, 4),
        "stability_convective_potential": convective.cast("double"),
        "temp_dewpt_spread": rnd(temp - dew, 2),
    }


def lake_breeze(air: Column, water: Column, solar_3h: Column, synoptic: Column, hour_local: Column) -> dict[str, Column]:
    delta = air - water
    suppression = clamp(1.0 - (synoptic - 3.0) / 12.0, 0.0, 1.0)
    time_factor = F.when(
        hour_local.between(9, 19), F.greatest(F.lit(0.0), 1.0 - F.abs(hour_local - 14) / 5.0)
    ).otherwise(F.lit(0.0))
    potential = (
        0.35 * clamp(delta / 8.0, 0.0, 1.0)
        + 0.25 * F.when(solar_3h.isNotNull(), F.least(F.lit(1.0), solar_3h / 1500.0))
        + 0.20 * suppression
        + 0.20 * time_factor
    )
    return {
        "lake_breeze_air_water_delta": rnd(delta, 2),
        "lake_breeze_solar_3h": rnd(solar_3h, 1),
        "lake_breeze_synoptic_suppression": rnd(suppression, 4),
        "lake_breeze_time_factor": rnd(time_factor, 4),
        "lake_breeze_potential": rnd(potential, 4),
    }


def foehn_strength(gradient: Column, temp: Column, dew: Column, direction: Column) -> dict[str, Column]:
    depression = temp - dew
    pg = clamp(gradient / 12.0, 0.0, 1.0)
    dry = clamp(depression / 15.0, 0.0, 1.0)
    # 1 from due north, falling to 0.7 at 45 degrees either side, 0 elsewhere.
    off_north = F.least(direction, 360.0 - direction)
    north = F.when(
        direction.isNotNull(),
        F.when(off_north <= 45.0, clamp(1.0 - off_north / 45.0 * 0.3, 0.0, 1.0)).otherwise(F.lit(0.0)),
    )
    return {
        "foehn_pg_score": rnd(pg, 4),
        "foehn_dewpoint_depression": rnd(depression, 2),
        "foehn_dewpt_score": rnd(dry, 4),
        "foehn_dir_score": rnd(north, 4),
        "foehn_strength_index": rnd(mean_of_present(pg, dry, north, at_least=2), 4),
    }


def shear(level_speed: Column, surface_speed: Column) -> Column:
    return level_speed - surface_speed
