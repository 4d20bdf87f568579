"""Reads behind the user interfaces: latest rows, nearest prediction, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmos import settings as cfg
from sparkmos.functions import decision, wind
from sparkmos.functions.common import micros, rnd
from sparkmos.functions.timefn import local, to_utc
from sparkmos.operators import tables
from sparkmos.operators.asof import nearest_in_time, reference_forecast
from sparkmos.operators.keyed import first_per_key


def newest_order(tie_break: Sequence[str] = ()) -> list[Column]:
    return [F.col("generated_at").desc(), F.col("valid_time"), *[F.col(c).desc() for c in tie_break]]


def latest_predictions(predictions: DataFrame, n: int, point_id: str | None = None, tie_break: Sequence[str] = ()) -> DataFrame:
    if point_id is not None:
        predictions = predictions.filter(F.col("point_id") == point_id)
    return predictions.orderBy(*newest_order(tie_break)).limit(n)


def latest_per_point(predictions: DataFrame, n: int, tie_break: Sequence[str] = ()) -> DataFrame:
    return first_per_key(predictions, ["point_id"], newest_order(tie_break), n, rank_as="rn")


def latest_at(predictions: DataFrame, target: Column, tolerance_s: int = 3600, tie_break: Sequence[str] = ()) -> DataFrame:
    """Per point the newest prediction less than ``tolerance_s`` from the target time."""
    reach = F.make_dt_interval(secs=F.lit(float(tolerance_s)))
    near = predictions.filter((F.col("valid_time") > target - reach) & (F.col("valid_time") < target + reach))
    return first_per_key(near, ["point_id"], [F.col("generated_at").desc(), *[F.col(c).desc() for c in tie_break]])


def prediction_at(targets: DataFrame, predictions: DataFrame, request_id: Sequence[str], tie_break: Sequence[str] = (), tolerance_s: int = 3600) -> DataFrame:
    """Per request (point_id, target) the prediction nearest in time, newest first on ties.

    Only the days that the targets can reach are read.
    """
    reach = f"INTERVAL '{tolerance_s}' SECOND"
    return nearest_in_time(
        targets,
        tables.within(predictions, "valid_time", targets, "target", reach, reach),
        keys=["point_id"],
        request_time="target",
        row_time="valid_time",
        tolerance_s=tolerance_s,
        request_id=request_id,
        tie_break=newest_order(tie_break),
    )


def with_raw_fallback(targets: DataFrame, predictions: DataFrame, forecasts: DataFrame, tie_break: Sequence[str] = ()) -> DataFrame:
    """Stored prediction per (point_id, target), else the raw forecast of the reference model."""
    stored = prediction_at(targets, predictions, ["point_id", "target"], tie_break).select(
        "point_id", "target", "model_version", "wind_speed_kn", "wind_dir_deg", "wind_gust_kn",
        "confidence_pct", "expected_error_kn",
    )
    raw = reference_forecast(
        targets.withColumnRenamed("target", "t"), forecasts,
        ["wind_speed_kn", "wind_dir_deg", "wind_gust_kn"], 60, cfg.REFERENCE_MODEL, tie_break=tie_break,
    ).filter("wind_speed_kn IS NOT NULL AND wind_dir_deg IS NOT NULL").select(
        "point_id",
        F.col("t").alias("target"),
        F.concat(F.lit("raw_"), "model_name").alias("r_version"),
        rnd(F.col("wind_speed_kn"), 1).alias("r_speed"),
        rnd(F.col("wind_dir_deg"), 0).alias("r_dir"),
        F.col("wind_gust_kn").alias("r_gust"),
    )
    got = F.col("model_version").isNotNull()

    def either(stored_col: str, raw_col: Column) -> Column:
        return F.when(got, F.col(stored_col)).otherwise(raw_col).alias(stored_col)

    has_raw = F.col("r_version").isNotNull()
    return (
        targets.join(stored, ["point_id", "target"], "left")
        .join(raw, ["point_id", "target"], "left")
        .filter(got | has_raw)
        .select(
            "point_id",
            "target",
            either("wind_speed_kn", F.col("r_speed")),
            either("wind_dir_deg", F.col("r_dir")),
            either("wind_gust_kn", F.col("r_gust")),
            either("confidence_pct", F.when(has_raw, 50.0)),
            either("expected_error_kn", F.when(has_raw, 3.0)),
            F.coalesce("model_version", "r_version").alias("model_version"),
        )
    )


def hours_of_day(df: DataFrame, as_of: Column, first: int, last: int, tz: Column | str = cfg.LOCAL_TZ) -> DataFrame:
    """One row per local hour of the local day of ``as_of``: ``hour`` and UTC ``target``."""
    midnight = F.date_trunc("day", local(as_of, tz)).cast("timestamp_ntz")
    return df.withColumn("hour", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn(
        "target", to_utc(midnight + F.make_dt_interval(hours=F.col("hour")), tz)
    )


def hourly_outlook(points: DataFrame, predictions: DataFrame, as_of: Column, hours: int = 24, tie_break: Sequence[str] = ()) -> DataFrame:
    """The prediction nearest to each of the next hours, within an hour, per point."""
    targets = points.select("point_id").withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(hours)))).withColumn(
        "target", as_of + F.make_dt_interval(hours=F.col("h"))
    )
    return prediction_at(targets, predictions, ["point_id", "h"], tie_break)


def hour_change(points: DataFrame, predictions: DataFrame, target: Column, tie_break: Sequence[str] = ()) -> DataFrame:
    """Prediction at the target and an hour earlier, with a word for the change."""
    targets = points.select("point_id").withColumn("back", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "target", target - F.make_dt_interval(hours=F.col("back"))
    )
    found = prediction_at(targets, predictions, ["point_id", "back"], tie_break)
    both = found.groupBy("point_id").agg(
        F.max(F.when(F.col("back") == 0, F.col("wind_speed_kn"))).alias("speed_now"),
        F.max(F.when(F.col("back") == 1, F.col("wind_speed_kn"))).alias("speed_before"),
    )
    return points.select("point_id").join(both, "point_id", "left").withColumn(
        "change", decision.change_verb(F.col("speed_now"), F.col("speed_before"))
    )


def trend(predictions: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Predictions around now, to be plotted in time order."""
    lo = as_of - F.make_dt_interval(hours=F.lit(hours + 1))
    hi = as_of + F.make_dt_interval(hours=F.lit(hours))
    return predictions.filter(F.col("valid_time").between(lo, hi)).orderBy("point_id", "valid_time")


def sailing_report(points: DataFrame, predictions: DataFrame, as_of: Column, tie_break: Sequence[str] = ()) -> DataFrame:
    """Per point over the local midday hours: peak, mean, hours with sailing wind, best hour.

    ``best`` marks the point to recommend: the highest peak among those with two such hours.
    """
    targets = hours_of_day(points.select("point_id", "idx"), as_of, 11, 16)
    at = prediction_at(targets, predictions, ["point_id", "hour"], tie_break).filter(
        "wind_speed_kn IS NOT NULL AND wind_speed_kn <> 0"
    )
    by_point = at.groupBy("point_id", "idx").agg(
        F.max("wind_speed_kn").alias("max_speed"),
        F.avg("wind_speed_kn").alias("avg_speed"),
        F.count(F.when(F.col("wind_speed_kn") >= cfg.SAIL_SPEED_KN, 1)).alias("sail_hours"),
        F.max_by("hour", F.struct("wind_speed_kn", -F.col("hour"))).alias("best_hour"),
    )
    best = by_point.filter("sail_hours >= 2").agg(
        F.max_by("point_id", F.struct("max_speed", -F.col("idx"))).alias("best_point")
    )
    # One row on the right, a single aggregate.
    return by_point.join(best, F.col("point_id") == F.col("best_point"), "left").select(
        "point_id", "max_speed", "avg_speed", "sail_hours", "best_hour", F.col("best_point").isNotNull().alias("best")
    )


def best_now(predictions: DataFrame) -> DataFrame:
    """The point to show first: the strongest wind among confident predictions."""
    return predictions.filter("wind_speed_kn IS NOT NULL AND confidence_pct >= 50").orderBy(
        F.col("wind_speed_kn").desc(), "point_id"
    ).limit(1)


def points_by_sector(points: DataFrame, sector: str = "sector") -> DataFrame:
    """Point names per sector; both come from the point dimension, so the lists stay short."""
    return points.groupBy(sector).agg(F.array_sort(F.collect_list("point_id")).alias("points"), F.count("*").alias("n"))


def enrich_with_points(predictions: DataFrame, points: DataFrame) -> DataFrame:
    return predictions.filter("wind_speed_kn IS NOT NULL").join(points.select("point_id", "lat", "lon"), "point_id")


def wind_card(predictions: DataFrame, units: Column) -> DataFrame:
    """Display columns of a prediction."""
    return predictions.withColumns(
        {
            "speed_shown": wind.in_units(F.col("wind_speed_kn"), units),
            "unit": wind.unit_label(units),
            "cardinal": wind.name_16(F.col("wind_dir_deg")),
            "decision": decision.sail_decision(F.col("wind_speed_kn"), F.col("confidence_pct")),
            "band": decision.speed_band(F.col("wind_speed_kn")),
            "confidence_band": decision.confidence_band(F.col("confidence_pct")),
        }
    )
