"""Source health, freshness, gaps, usage counts, model registry reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmos import settings as cfg
from sparkmos.functions import decision
from sparkmos.functions.common import micros, rnd
from sparkmos.operators.keyed import newest_with_ties


def latest_health(health: DataFrame) -> DataFrame:
    return newest_with_ties(health, ["source"], "checked_at")


def freshness(health: DataFrame, as_of: Column) -> DataFrame:
    """Age of the newest check per source against its allowance."""
    age = decision.age_minutes(as_of, F.col("checked_at"))
    sla = decision.sla_minutes(F.col("source"))
    return latest_health(health).select(
        "source",
        F.col("checked_at").alias("last_check_at"),
        rnd(age, 1).alias("age_minutes"),
        sla.alias("sla_minutes"),
        (age <= sla).alias("is_fresh"),
        F.coalesce("ok", F.lit(False)).alias("ok"),
    )


def freshness_penalty(status: DataFrame) -> DataFrame:
    """One row: the confidence penalty of all stale sources together."""
    stale = F.when(~F.col("is_fresh"), decision.stale_penalty(F.col("source")))
    return status.agg(
        F.round(F.least(F.lit(cfg.MAX_STALE_PENALTY), F.coalesce(F.sum(stale), F.lit(0.0))), 9).alias("penalty")
    )


def extent(df: DataFrame, time: str, as_of: Column, name: str) -> DataFrame:
    """Earliest, latest, count, gap in days, and whether the gap calls for recovery."""
    gap = F.coalesce((micros(as_of) - micros("latest")) / 86400e6, F.lit(9999.0))
    return df.agg(F.min(time).alias("earliest"), F.max(time).alias("latest"), F.count("*").alias("n")).select(
        F.lit(name).alias("dataset"), "earliest", "latest", "n", rnd(gap, 2).alias("gap_days"), (gap > 1.0).alias("needs_recovery")
    )


def extent_by_source(observations: DataFrame, as_of: Column) -> DataFrame:
    gap = (micros(as_of) - micros("latest")) / 3600e6
    return observations.groupBy("source").agg(F.max("timestamp").alias("latest"), F.count("*").alias("n")).withColumn(
        "gap_hours", rnd(gap, 1)
    )


def recovery_ranges(extents: DataFrame, as_of: Column, max_days: int = 365, force: bool = False) -> DataFrame:
    """What to fetch again: from an hour before the newest row (``max_days`` ago if none)."""
    due = F.lit(True) if force else F.col("needs_recovery")
    return extents.filter(due).select(
        "dataset",
        "gap_days",
        F.coalesce(
            F.col("latest") - F.expr("INTERVAL '1' HOUR"), as_of - F.make_dt_interval(days=F.lit(max_days))
        ).alias("start"),
        as_of.alias("end"),
    )


def missing_hours(points: DataFrame, stored: DataFrame, start: Column, end: Column, time: str = "valid_time") -> DataFrame:
    """Hours of [start, end) without any row, per point."""
    spine = points.select(
        "point_id", F.explode(F.sequence(start, end - F.expr("INTERVAL '1' HOUR"), F.expr("INTERVAL '1' HOUR"))).alias("hour")
    )
    have = stored.select("point_id", F.date_trunc("hour", F.col(time)).cast("timestamp_ntz").alias("hour")).distinct()
    return spine.join(have, ["point_id", "hour"], "left_anti")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def class_counts(forecasts: DataFrame, observations: DataFrame) -> DataFrame:
    """Rows per kind of source. In LIKE an underscore is a wildcard, as in the report's SQL."""
    ens = F.col("model_name").like("%_ens")
    f = forecasts.agg(
        F.count(F.when(~ens, 1)).alias("open_meteo"), F.count(F.when(ens, 1)).alias("open_meteo_ensemble")
    ).select(F.expr("stack(2, 'open_meteo', open_meteo, 'open_meteo_ensemble', open_meteo_ensemble) AS (source, n)"))
    o = observations.agg(
        F.count(F.when(F.col("source") == "domaso_live", 1)).alias("d"),
        F.count(F.when(F.col("source").like("arpa_%"), 1)).alias("a"),
        F.count(F.when(F.col("source") == "era5_reanalysis", 1)).alias("e"),
    ).select(F.expr("stack(3, 'domaso_live', d, 'arpa_lombardia', a, 'era5_reanalysis', e) AS (source, n)"))
    return f.unionByName(o)


def source_status(health: DataFrame, forecasts: DataFrame, observations: DataFrame, as_of: Column) -> DataFrame:
    """Newest check per source with freshness and stored rows."""
    status = freshness(health, as_of).join(
        latest_health(health).select("source", F.col("checked_at").alias("last_check_at"), "latency_ms").distinct(),
        ["source", "last_check_at"],
    )
    return status.join(class_counts(forecasts, observations), "source", "left")


def recent_failures(health: DataFrame, n: int = 3) -> DataFrame:
    return health.filter(~F.col("ok")).orderBy(F.col("checked_at").desc(), "source").limit(n)


def newest(df: DataFrame, time: str, n: int, *tie_break: str) -> DataFrame:
    return df.orderBy(F.col(time).desc(), *tie_break).limit(n)


def usage(users: DataFrame, alerts: DataFrame, as_of: Column, seen: str = "last_seen_at") -> DataFrame:
    """One row of usage counts."""

    def since(hours: int) -> Column:
        return F.count(F.when(F.col(seen) > as_of - F.make_dt_interval(hours=F.lit(hours)), 1))

    enabled = alerts.filter("enabled").agg(F.count("*").alias("n")).scalar()
    return users.agg(
        F.count("*").alias("total_users"),
        F.count(F.when(F.col("is_allowed"), 1)).alias("allowed_users"),
        since(24).alias("active_24h"),
        since(24 * 7).alias("active_7d"),
    ).withColumn("active_alerts", enabled)


def production_model(registry: DataFrame) -> DataFrame:
    """The promoted model, else the newest trained one."""
    return registry.orderBy(
        F.coalesce("promoted_to_production", F.lit(False)).desc(), F.col("trained_at").desc(), "model_version"
    ).limit(1)


def retrain_decision(registry: DataFrame, forecasts: DataFrame, min_rows: int = cfg.RETRAIN_MIN_NEW_ROWS) -> DataFrame:
    """Rows whose run is newer than the last training, and whether that is enough."""
    last = registry.agg(F.max("trained_at").alias("last_trained")).scalar()
    newer = last.isNull() | (F.col("run_time") > last)
    return forecasts.agg(F.count(F.when(newer, 1)).alias("n_new")).select(
        last.alias("last_trained"), "n_new", (F.col("n_new") > min_rows).alias("retrain")
    )
