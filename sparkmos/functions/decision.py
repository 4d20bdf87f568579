"""Sailing decisions, bands, confidence, gust checks, regimes, freshness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkmos import settings as cfg
from sparkmos.functions.common import clamp, lookup, micros


def sail_decision(speed_kn: Column, confidence: Column) -> Column:
    return (
        F.when((speed_kn >= 8) & (confidence >= 50), F.lit("GO"))
        .when((speed_kn >= 5) & (confidence >= 40), F.lit("MARGINAL"))
        .otherwise(F.lit("STAY"))
    )


def speed_band(speed_kn: Column) -> Column:
    return (
        F.when(speed_kn < 5, F.lit("calm"))
        .when(speed_kn < 10, F.lit("sailing"))
        .when(speed_kn < 16, F.lit("good"))
        .when(speed_kn < 22, F.lit("strong"))
        .when(speed_kn.isNotNull(), F.lit("very_strong"))
    )


def confidence_band(confidence: Column) -> Column:
    return (
        F.when(confidence >= 75, F.lit("high"))
        .when(confidence >= 50, F.lit("medium"))
        .when(confidence.isNotNull(), F.lit("low"))
    )


def expected_error(u10: Column, u90: Column, v10: Column, v90: Column) -> Column:
    """Half the combined width of the two 10-90 intervals."""
    return F.hypot(u90 - u10, v90 - v10) / 2.0


def confidence(error_kn: Column, station_missing: Column, n_models: Column, expected_models: int = len(cfg.MODELS)) -> Column:
    base = clamp(95.0 - 9.0 * error_kn, 20.0, 95.0)
    station = F.when(station_missing, cfg.CONFIDENCE_PER_MISSING_STATION).otherwise(0.0)
    models = F.greatest(F.lit(0), F.lit(expected_models) - n_models) * cfg.CONFIDENCE_PER_MISSING_MODEL
    return clamp(base - station - models, 10.0, 99.0)


def gust_from_ratio(ref_gust: Column, ref_speed: Column, speed: Column) -> Column:
    """Scale the reference gust with the corrected speed, then keep it plausible."""
    scaled = F.when(ref_speed > 0.1, speed * (ref_gust / ref_speed)).otherwise(ref_gust)
    raised = F.when(scaled < 0.9 * speed, speed * 1.3).otherwise(scaled)
    return F.when(raised > 3.0 * speed, speed * 2.5).otherwise(raised)


def quantiles_cross(q10: Column, q50: Column, q90: Column) -> Column:
    return (q10 > q50) | (q50 > q90)


def sorted_quantiles(q10: Column, q50: Column, q90: Column) -> Column:
    return F.array_sort(F.array(q10, q50, q90))


def regime_rules(clock: Column, foehn_likely: Column, foehn_strong: Column, cape: Column, speed: Column) -> dict[str, Column]:
    def sure(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    return {
        "breva_window": clock.between("10:00", "18:00"),
        "tivano_window": clock.between("04:00", "09:30"),
        "foehn_likely": sure(foehn_likely),
        "foehn_strong": sure(foehn_strong),
        "high_cape": sure(cape > 1000),
        # A speed of exactly zero does not count as low (it reads as missing).
        "low_speed": sure((speed < 3.0) & (speed != 0.0)),
        "strong_speed": sure(speed > 18.0),
    }


def regime(rules: dict[str, Column]) -> tuple[Column, Column]:
    """(label, confidence), first matching rule wins."""
    ladder = [
        (rules["foehn_strong"], "foehn", 0.95),
        (rules["high_cape"] & rules["strong_speed"], "storm", 0.85),
        (rules["foehn_likely"], "foehn", 0.80),
        (rules["breva_window"] & ~rules["low_speed"], "breva", 0.75),
        (rules["tivano_window"] & ~rules["low_speed"], "tivano", 0.75),
    ]
    label, conf = F.when(ladder[0][0], ladder[0][1]), F.when(ladder[0][0], ladder[0][2])
    for cond, name, value in ladder[1:]:
        label, conf = label.when(cond, name), conf.when(cond, value)
    return label.otherwise(F.lit("calm")), conf.otherwise(F.lit(0.60))


def age_minutes(as_of: Column, checked_at: Column) -> Column:
    return F.coalesce((micros(as_of) - micros(checked_at)) / 60e6, F.lit(9999.0))


def sla_minutes(source: Column) -> Column:
    return lookup(cfg.FRESHNESS_SLA_MINUTES, source, cfg.DEFAULT_SLA_MINUTES)


def stale_penalty(source: Column) -> Column:
    return lookup(cfg.STALE_PENALTY, source, cfg.DEFAULT_STALE_PENALTY)


def observation_confidence(distance_km: Column, age_min: Column) -> Column:
    return F.when(
        distance_km.isNotNull(),
        1.0 / (1.0 + distance_km / 5.0 + F.greatest(F.lit(0.0), age_min) / 30.0),
    ).otherwise(F.lit(0.0))


def conformal_shift(prediction: Column, q_hat: Column, quantile: Column, error: Column) -> Column:
    """Move the outer quantiles apart by q_hat, scaled by the expected error; keep the median."""
    scale = F.when(error >= 0.1, error / 0.1).otherwise(F.lit(1.0))
    sign = F.when(quantile < 0.5, -1.0).when(quantile > 0.5, 1.0).otherwise(0.0)
    return prediction + sign * F.coalesce(q_hat, F.lit(0.0)) * scale


def conformal_margin(q_hat: Column, error: Column) -> Column:
    return q_hat * F.when(error > 0.1, error / 0.1).otherwise(F.lit(1.0))


def change_verb(now: Column, before: Column) -> Column:
    delta = now - before
    return (
        F.when(now.isNull(), F.lit("none"))
        .when(before.isNull(), F.lit("no_prior"))
        .when(F.abs(delta) < 0.5, F.lit("steady"))
        .when(delta > 0, F.lit("up"))
        .otherwise(F.lit("down"))
    )


# --- Fixed values: feature name prefix -> group, first match wins. ---
FEATURE_GROUPS = [
    ("fc_", "forecast"),
    ("agree_", "agreement"),
    ("ens_", "ensemble"),
    ("foehn", "foehn"),
    ("solar", "solar"),
    ("thermal", "thermal_inertia"),
    ("pressure_grad", "macro_area_pressure"),
    ("stability", "stability"),
    ("lake_breeze", "lake_breeze"),
    ("lag", "persistence"),
    ("obs_", "ground_station"),
]
TEMPORAL_FEATURES = ["hour_local", "day_of_year", "month", "season", "is_weekend"]
# --- End of fixed values. ---


def feature_group(name: Column) -> Column:
    expr = F.when(name.startswith(FEATURE_GROUPS[0][0]), FEATURE_GROUPS[0][1])
    for prefix, group in FEATURE_GROUPS[1:]:
        expr = expr.when(name.startswith(prefix), group)
    return (
        expr.when(name.isin(*TEMPORAL_FEATURES), F.lit("temporal"))
        .when(name.contains("_"), F.element_at(F.split(name, "_"), 1))
        .otherwise(F.lit("other"))
    )
