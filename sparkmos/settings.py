"""Configuration values. All of them are parameters of the operators that use them."""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: names, coordinates, thresholds and tables that results depend on. ---


@dataclass(frozen=True)
class Point:
    point_id: str
    lat: float
    lon: float
    is_operational: bool = True


POINTS = (
    Point("dongo_shore", 46.1230, 9.2850),
    Point("gravedona_shore", 46.1460, 9.3050),
    Point("domaso_offshore", 46.1500, 9.3230),
    Point("mid_channel", 46.1000, 9.3040),
    Point("piona_entrance", 46.1140, 9.3100),
    Point("dervio_shore", 46.0763, 9.2980),
    Point("bellano_offshore", 46.0550, 9.3000),
    Point("zurich", 47.376, 8.541, False),
    Point("milano_linate", 45.445, 9.278, False),
    Point("sondrio", 46.170, 9.870, False),
    Point("lugano", 46.005, 8.952, False),
)
OPERATIONAL = tuple(p for p in POINTS if p.is_operational)

LOCAL_TZ = "Europe/Rome"
REFERENCE_MODEL = "icon_eu"
SYNOPTIC_MODEL = "ecmwf_ifs025"
MODELS = (
    "icon_d2",
    "icon_eu",
    "ecmwf_ifs025",
    "gfs_seamless",
    "italia_meteo_arpae_icon_2i",
)
ENSEMBLE_MODELS = ("icon_seamless", "gfs_seamless", "ecmwf_ifs025")

FOEHN_LIKELY_HPA = 8.0
FOEHN_STRONG_HPA = 12.0

# Pressure anchors: short name -> point.
ANCHORS = {
    "zurich": "zurich",
    "milano": "milano_linate",
    "sondrio": "sondrio",
    "lugano": "lugano",
    "dongo": "dongo_shore",
    "bellano": "bellano_offshore",
}
# Gradient name -> (first anchor, second anchor).
ANCHOR_GRADIENTS = {
    "zurich_milano": ("zurich", "milano"),
    "zurich_sondrio": ("zurich", "sondrio"),
    "sondrio_lugano": ("sondrio", "lugano"),
    "milano_lake": ("milano", "dongo"),
    "dongo_bellano": ("dongo", "bellano"),
    "lugano_milano": ("lugano", "milano"),
}

PHYSICAL_LIMITS = {
    "wind_speed_kn": (0.0, 120.0),
    "wind_gust_kn": (0.0, 150.0),
    "wind_dir_deg": (0.0, 360.0),
    "pressure": (850.0, 1100.0),
    "temperature": (-50.0, 60.0),
    "humidity": (0.0, 100.0),
    "cloud_cover": (0.0, 100.0),
    "cape": (0.0, 8000.0),
}

FRESHNESS_SLA_MINUTES = {
    "open_meteo": 60,
    "open_meteo_ensemble": 60,
    "domaso_live": 20,
    "arpa_lombardia": 30,
    "era5_reanalysis": 300,
    "diy_buoy": 5,
}
DEFAULT_SLA_MINUTES = 60
STALE_PENALTY = {
    "open_meteo": 0.25,
    "open_meteo_ensemble": 0.25,
    "domaso_live": 0.10,
    "arpa_lombardia": 0.10,
}
DEFAULT_STALE_PENALTY = 0.05
MAX_STALE_PENALTY = 0.5

LAG_MINUTES = (15, 60, 240)
THERMAL_HOURS = 6
SOLAR_HOURS = 3
HORIZONS_HOURS = (0, 1, 3, 6, 24)
QUANTILES = (0.1, 0.5, 0.9)

CONFIDENCE_PER_MISSING_MODEL = 5.0
CONFIDENCE_PER_MISSING_STATION = 3.0

TRAIN_DAYS = 60
TEST_DAYS = 14
STEP_DAYS = 7
MIN_TRAIN_SAMPLES = 200

SUCCESS_CRITERIA = {
    "mae_reduction_vs_raw_nwp_pct": 15.0,
    "mae_reduction_vs_persistence_pct": 25.0,
    "dir_error_reduction_pct": 20.0,
    "confidence_interval_coverage_pct": 75.0,
    "decision_precision_pct": 80.0,
}
PROMOTE_MIN_MAE_GAIN_KN = 0.2
PROMOTE_MIN_DIR_GAIN_DEG = 5.0
PROMOTE_MIN_REAL_SAMPLES = 50

RETRAIN_MIN_NEW_ROWS = 5000
SAIL_SPEED_KN = 8.0
ALERT_COOLDOWN_HOURS = 6
COMMANDS_PER_HOUR = 60
# --- End of fixed values. ---
