"""Explicit schemas of the stored tables. ``timestamp_ntz`` means zone-less UTC."""

from __future__ import annotations

from pyspark.sql.types import StructType

FORECAST_KEY = ["model_name", "point_id", "run_time", "valid_time"]
OBSERVATION_KEY = ["source", "timestamp", "lat", "lon"]
CLIMATOLOGY_KEY = ["point_id", "timestamp"]

FORECAST_FIELDS = [
    "wind_speed_kn", "wind_dir_deg", "wind_gust_kn", "pressure_msl", "temperature_2m",
    "dew_point_2m", "cloud_cover", "shortwave_radiation", "cape", "boundary_layer_height",
    "precipitation", "weather_code", "visibility",
]
UPPER_AIR_FIELDS = [
    "wind_speed_80m", "wind_direction_80m", "wind_speed_120m", "wind_direction_120m",
    "wind_speed_850hPa", "wind_direction_850hPa", "temperature_850hPa",
    "geopotential_height_500hPa", "wind_speed_500hPa", "wind_direction_500hPa",
]
OBSERVATION_FIELDS = [
    "wind_speed_kn", "wind_dir_deg", "wind_gust_kn", "pressure", "temperature", "humidity",
]
CLIMATOLOGY_FIELDS = [
    "wind_speed_10m", "wind_direction_10m", "wind_gusts_10m", "temperature_2m",
    "relative_humidity_2m", "dew_point_2m", "pressure_msl", "surface_pressure",
    "cloud_cover", "cloud_cover_low", "cloud_cover_mid", "cloud_cover_high",
    "shortwave_radiation", "precipitation", "cape",
]


def _doubles(names: list[str]) -> str:
    return ", ".join(f"{n} double" for n in names)


DDL = {
    "forecast_runs": (
        "id bigint, model_name string, point_id string, run_time timestamp_ntz, valid_time timestamp_ntz, "
        + ", ".join(f"{n} {'int' if n == 'weather_code' else 'double'}" for n in FORECAST_FIELDS)
        + ", raw_json string"
    ),
    "observations": (
        "id bigint, source string, timestamp timestamp_ntz, lat double, lon double, "
        + _doubles(OBSERVATION_FIELDS)
        + ", quality_flag string, confidence double"
    ),
    "sailing_log": (
        "id bigint, session_start timestamp_ntz, session_end timestamp_ntz, point_id string, "
        "perceived_wind_kn double, perceived_direction_deg double, sail_config string, notes string, "
        "gps_track_path string"
    ),
    "features": (
        "id bigint, point_id string, valid_time timestamp_ntz, feature_set_version string, "
        "feature_vector string, target_u double, target_v double"
    ),
    "predictions": (
        "id bigint, point_id string, generated_at timestamp_ntz, valid_time timestamp_ntz, "
        "model_version string, wind_speed_kn double, wind_dir_deg double, wind_gust_kn double, "
        "confidence_pct double, expected_error_kn double"
    ),
    "model_registry": (
        "model_version string, trained_at timestamp_ntz, feature_set_version string, "
        "training_period_start date, training_period_end date, backtest_mae_kn double, "
        "backtest_dir_error_deg double, promoted_to_production boolean, git_commit string, notes string"
    ),
    "source_health": (
        "source string, checked_at timestamp_ntz, ok boolean, latency_ms double, error_msg string"
    ),
    "experiment_attempts": (
        "id bigint, attempted_at timestamp_ntz, candidate_name string, feature_set_version string, "
        "backtest_mae_kn double, backtest_dir_error_deg double, vs_production_mae_delta double, "
        "vs_production_dir_delta double, promoted boolean, notes string"
    ),
    "v2_users": (
        "telegram_user_id bigint, username string, first_name string, language string, timezone string, "
        "units string, favorite_point_id string, is_allowed boolean, is_admin boolean, "
        "quiet_hours_start string, quiet_hours_end string, rate_limit_per_hour int, "
        "created_at timestamp_ntz, last_seen_at timestamp_ntz, notes string"
    ),
    "v2_alerts": (
        "id bigint, telegram_user_id bigint, point_id string, threshold_kn double, "
        "min_duration_minutes int, lead_window_hours int, label string, enabled boolean, "
        "last_triggered_at timestamp_ntz, created_at timestamp_ntz"
    ),
    "v2_subscriptions": (
        "id bigint, telegram_user_id bigint, kind string, local_time string, last_sent_at timestamp_ntz, "
        "enabled boolean, payload string, created_at timestamp_ntz"
    ),
    "v2_feedback": (
        "id bigint, telegram_user_id bigint, received_at timestamp_ntz, point_id string, "
        "valid_time timestamp_ntz, predicted_speed_kn double, observed_speed_kn double, notes string"
    ),
    "v4_climatology": "point_id string, timestamp timestamp_ntz, " + _doubles(CLIMATOLOGY_FIELDS),
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(DDL[table])
