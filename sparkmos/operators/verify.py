"""Pairing forecasts with observations, errors, and the score aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmos import settings as cfg
from sparkmos.functions.common import micros, minute_index, rnd
from sparkmos.functions.timefn import local
from sparkmos.functions.wind import direction_error
from sparkmos.operators.keyed import first_per_key
from sparkmos.session import materialize


def nearest_of_all(times: DataFrame, obs: DataFrame, tolerance_s: int, tie_break: Sequence[str] = ()) -> DataFrame:
    """Per distinct ``valid_time`` the row of ``obs`` nearest in time, whatever its station; of two equally near the newer.

    Observations are read once. Reduced to one per distinct time, they are laid in order with
    the valid times, first a minute at a time: the last one before and the first one after a
    valid time are found in its own minute, and of the minute only its first and last
    observation go on. These are laid in order by the hour, each in its neighbours' hours too.
    So no hour of many readings is sorted as a whole, and an hour has at most 120 of them.
    """
    one = first_per_key(obs, ["obs_time"], [F.col("obs_source"), *[F.col(c).desc() for c in tie_break]])
    kind = one.select(F.struct(*one.columns).alias("o")).schema["o"].dataType
    v = F.col("valid_time")
    line = one.select(F.col("obs_time").alias("at"), F.struct(*one.columns).alias("o"), F.lit(None).cast("timestamp_ntz").alias("valid_time")).unionByName(
        times.select(v.alias("at"), F.lit(None).cast(kind).alias("o"), v).distinct()
    )

    def around(df: DataFrame, part: str, before: str, after: str) -> DataFrame:
        # At the same time the observation comes first.
        w = Window.partitionBy(part).orderBy("at", v.isNotNull())
        return df.withColumns(
            {
                before: F.last("o", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
                after: F.first("o", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
            }
        )

    minutes = around(line.withColumn("_minute", minute_index("at")), "_minute", "b", "a")
    edges = minutes.filter(v.isNotNull() | F.col("b").isNull() | F.col("a").isNull())
    reach, hour = -(-tolerance_s // 3600), F.floor(micros("at") / 3_600_000_000)
    hours = F.when(v.isNull(), F.sequence(hour - reach, hour + reach)).otherwise(F.array(hour))
    seen = around(edges.withColumn("_hour", F.explode(hours)), "_hour", "bb", "aa").filter(v.isNotNull())
    before, after = F.coalesce("b", "bb"), F.coalesce("a", "aa")
    away = lambda o: F.abs(micros(o["obs_time"]) - micros(v))
    nearest = F.when(after.isNull() | (away(before) < away(after)), before).otherwise(after)
    found = seen.select(v, nearest.alias("n")).filter(away(F.col("n")) <= tolerance_s * 1_000_000)
    return found.select(v, "n.*").withColumn("diff_s", F.abs(micros("obs_time") - micros(v)) / 1e6)


def matched_pairs(
    predictions: DataFrame, observations: DataFrame, *, speed_required: bool = True, tolerance_s: int = 3600,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Every prediction with the observation nearest in time to its valid time.

    The station's place does not matter, so the nearest observation is found once per
    distinct valid time; of two equally near ones the newer wins. An exact match counts.
    ``speed_required`` looks only at observations with a speed.
    """
    obs = observations.filter("wind_speed_kn IS NOT NULL") if speed_required else observations
    obs = obs.select(
        F.col("timestamp").alias("obs_time"),
        F.col("source").alias("obs_source"),
        F.col("wind_speed_kn").alias("obs_speed"),
        F.col("wind_dir_deg").alias("obs_dir"),
        *[F.col(c).alias(f"obs_{c}") for c in tie_break],
    )
    nearest = nearest_of_all(predictions.select("valid_time").distinct(), obs, tolerance_s, [f"obs_{c}" for c in tie_break])
    good = predictions.filter("wind_speed_kn IS NOT NULL")
    return good.join(nearest, "valid_time").filter("obs_speed IS NOT NULL").withColumns(
        {
            "error": F.col("wind_speed_kn") - F.col("obs_speed"),
            "abs_error": F.abs(F.col("wind_speed_kn") - F.col("obs_speed")),
            "dir_error": direction_error(F.col("wind_dir_deg"), F.col("obs_dir")),
            "is_reanalysis": F.col("obs_source").contains("era5"),
        }
    )


def in_decision_hours(t: Column | str) -> Column:
    return F.hour(local(t)).between(11, 16)


def decision_hit(predicted: Column, observed: Column) -> Column:
    return ((predicted >= cfg.SAIL_SPEED_KN) == (observed >= cfg.SAIL_SPEED_KN)).cast("double")


def accuracy_report(pairs: DataFrame, as_of: Column) -> DataFrame:
    """Per point over the last 30 days: errors, their split by source, decision hits."""
    age = (micros(as_of) - micros("valid_time")) / 86400e6
    recent = pairs.filter(F.col("valid_time") >= as_of - F.make_dt_interval(days=F.lit(30)))
    week = F.when(age <= 7, F.col("abs_error"))
    hit = F.when(in_decision_hours("valid_time"), decision_hit(F.col("wind_speed_kn"), F.col("obs_speed")))
    return recent.groupBy("point_id").agg(
        F.avg(week).alias("mae_7d"),
        F.count(week).alias("n_7d"),
        F.avg("abs_error").alias("mae_30d"),
        F.count("abs_error").alias("n_30d"),
        F.avg("dir_error").alias("dir_error"),
        F.count("dir_error").alias("n_dir"),
        F.avg(F.when(F.col("is_reanalysis"), F.col("abs_error"))).alias("mae_reanalysis"),
        F.avg(F.when(~F.col("is_reanalysis"), F.col("abs_error"))).alias("mae_station"),
        (F.avg(hit) * 100.0).alias("hit_rate_pct"),
        F.count(hit).alias("n_decisions"),
    )


def error_histogram(pairs: DataFrame, bins: int = 30, keys: Sequence[str] = ()) -> DataFrame:
    """Counts over ``bins`` equal bins between the smallest and the largest error.

    The errors are written once: the bounds and the counts both read them.
    """
    pairs = materialize(pairs.select(*keys, "error"))
    bounds = pairs.groupBy(*keys).agg(F.min("error").alias("lo"), F.max("error").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    if keys:
        both = pairs.select(*keys, "error").join(bounds, list(keys))
    else:
        # One row of bounds; read as one scalar subquery, so no join is needed.
        one = bounds.select(F.struct("lo", "hi").alias("b")).scalar()
        both = pairs.select("error").withColumn("_b", one).select("error", "_b.lo", "_b.hi")
    index = F.when(width > 0, F.least(F.floor((F.col("error") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    return both.groupBy(*keys, index.alias("bin")).agg(
        F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )


def validation_summary(pairs: DataFrame, min_pairs: int = 10) -> DataFrame:
    """Per point: pairs, mean error, MAE by kind of source; nothing below ``min_pairs``."""
    return (
        pairs.groupBy("point_id")
        .agg(
            F.count("*").alias("n_pairs"),
            F.avg("error").alias("mean_error"),
            F.avg(F.when(F.col("is_reanalysis"), F.col("abs_error"))).alias("mae_reanalysis"),
            F.count(F.when(F.col("is_reanalysis"), 1)).alias("n_reanalysis"),
            F.avg(F.when(~F.col("is_reanalysis"), F.col("abs_error"))).alias("mae_station"),
            F.count(F.when(~F.col("is_reanalysis"), 1)).alias("n_station"),
        )
        .filter(F.col("n_pairs") >= min_pairs)
    )


def last_pairs(pairs: DataFrame, n: int = 100, tie_break: Sequence[str] = ()) -> DataFrame:
    """The newest ``n`` pairs per point, for the time-series panel."""
    return first_per_key(pairs, ["point_id"], [F.col("valid_time").desc(), *[F.col(c).desc() for c in tie_break]], n)


# --- Scores of a candidate against persistence and the raw forecast. ---


def with_errors(samples: DataFrame) -> DataFrame:
    """Errors of candidate, persistence and raw forecast, from speeds and directions.

    Expects obs_speed, obs_dir, obs_source, ref_speed, ref_dir, cand_speed, cand_dir,
    cand_error, pers_speed, pers_dir and valid_time.
    """
    c, o = F.col("cand_speed"), F.col("obs_speed")
    return samples.withColumns(
        {
            "cand_err": F.abs(c - o),
            "cand_dir_err": direction_error(F.col("cand_dir"), F.col("obs_dir")),
            "pers_err": F.abs(F.col("pers_speed") - o),
            "pers_dir_err": direction_error(F.col("pers_dir"), F.col("obs_dir")),
            "nwp_err": F.abs(F.col("ref_speed") - o),
            "nwp_dir_err": direction_error(F.col("ref_dir"), F.col("obs_dir")),
            "covered": o.between(F.greatest(F.lit(0.0), c - F.col("cand_error")), c + F.col("cand_error")).cast("double"),
            "hit": F.when(in_decision_hours("valid_time"), decision_hit(c, o)),
            "is_reanalysis": F.col("obs_source") == "era5_reanalysis",
        }
    )


def skill_pct(candidate: Column, base: Column) -> Column:
    return F.when(base > 0, (1.0 - candidate / base) * 100.0).otherwise(F.lit(0.0))


SCORES = {
    "candidate_mae_kn": "cand_err",
    "candidate_dir_error_deg": "cand_dir_err",
    "persistence_mae_kn": "pers_err",
    "persistence_dir_error_deg": "pers_dir_err",
    "raw_nwp_mae_kn": "nwp_err",
    "raw_nwp_dir_error_deg": "nwp_dir_err",
}


def score(errors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Means with their own denominators, skill, coverage, decision hits, split by source."""
    era5, real = F.col("is_reanalysis"), ~F.col("is_reanalysis")
    raw = errors.groupBy(*keys).agg(
        F.count("cand_err").alias("n_test_samples"),
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(name) for name, c in SCORES.items()],
        (F.coalesce(F.avg("covered"), F.lit(0.0)) * 100.0).alias("confidence_interval_coverage_pct"),
        (F.coalesce(F.avg("hit"), F.lit(0.0)) * 100.0).alias("decision_precision_pct"),
        F.count(F.when(era5, 1)).alias("n_era5_samples"),
        F.count(F.when(real, 1)).alias("n_real_samples"),
        F.avg(F.when(era5, F.col("cand_err"))).alias("candidate_mae_vs_era5"),
        F.avg(F.when(real, F.col("cand_err"))).alias("candidate_mae_vs_real"),
        F.avg(F.when(era5, F.col("nwp_err"))).alias("nwp_mae_vs_era5"),
        F.avg(F.when(real, F.col("nwp_err"))).alias("nwp_mae_vs_real"),
    )
    skilled = raw.withColumns(
        {
            "mae_reduction_vs_raw_nwp_pct": skill_pct(F.col("candidate_mae_kn"), F.col("raw_nwp_mae_kn")),
            "mae_reduction_vs_persistence_pct": skill_pct(F.col("candidate_mae_kn"), F.col("persistence_mae_kn")),
            "dir_error_reduction_pct": skill_pct(F.col("candidate_dir_error_deg"), F.col("raw_nwp_dir_error_deg")),
        }
    )
    met = F.lit(True)
    for name, target in cfg.SUCCESS_CRITERIA.items():
        met = met & (F.col(name) >= target)
    out = skilled.withColumn("success_criteria_met", met)
    digits = {c: 3 for c in out.columns if c.endswith("_kn") or "_mae_vs_" in c}
    digits |= {c: 2 for c in out.columns if c.endswith(("_deg", "_pct"))}
    return out.withColumns({c: rnd(F.col(c), d) for c, d in digits.items()})


REGIMES = ["breva", "tivano", "foehn", "calm"]


def score_regime(breva: Column, tivano: Column, foehn: Column) -> Column:
    return F.when(breva, "breva").when(tivano, "tivano").when(foehn, "foehn").otherwise(F.lit("calm"))


def regime_scores(errors: DataFrame, regime: str = "regime") -> DataFrame:
    """Errors per regime; every regime has a row, empty ones with zeros."""
    names = ", ".join(f"('{r}')" for r in REGIMES)
    every = errors.sparkSession.sql(f"SELECT * FROM VALUES {names} AS t({regime})")
    found = errors.groupBy(regime).agg(
        F.count("cand_err").alias("n"),
        F.avg("cand_err").alias("cand_mae_kn"),
        F.avg("pers_err").alias("pers_mae_kn"),
        F.avg("nwp_err").alias("nwp_mae_kn"),
    )
    zero = F.lit(0.0)
    return every.join(found, regime, "left").select(
        regime,
        F.coalesce("n", F.lit(0)).alias("n"),
        *[F.coalesce(c, zero).alias(c) for c in ("cand_mae_kn", "pers_mae_kn", "nwp_mae_kn")],
    )


def promotion(report: DataFrame, registry: DataFrame, candidate: str, force: bool = False) -> DataFrame:
    """One row: gains over the production model and whether the candidate is promoted."""
    current = registry.filter("promoted_to_production").orderBy(F.col("trained_at").desc(), "model_version").limit(1)
    infinite = F.lit(float("inf"))
    mae = F.coalesce(F.nullif(current.select("backtest_mae_kn").scalar(), F.lit(0.0)), infinite)
    direction = F.coalesce(current.select("backtest_dir_error_deg").scalar(), infinite)
    gained = report.select(
        F.lit(candidate).alias("candidate_name"),
        F.col("candidate_mae_kn").alias("backtest_mae_kn"),
        F.col("candidate_dir_error_deg").alias("backtest_dir_error_deg"),
        (mae - F.col("candidate_mae_kn")).alias("vs_production_mae_delta"),
        (direction - F.col("candidate_dir_error_deg")).alias("vs_production_dir_delta"),
        "n_real_samples",
    )
    gate = (
        (F.col("vs_production_mae_delta") >= cfg.PROMOTE_MIN_MAE_GAIN_KN)
        & (F.col("vs_production_dir_delta") >= cfg.PROMOTE_MIN_DIR_GAIN_DEG)
        & (F.col("n_real_samples") >= cfg.PROMOTE_MIN_REAL_SAMPLES)
    )
    return gained.withColumn("promoted", F.lit(force) | gate)


def previous_observation(samples: DataFrame, order: Sequence[str], per_point: bool = False) -> DataFrame:
    """Observed speed of the sample before, if it belongs to the same point.

    As coded the samples of all points interleave in time order, so "the sample before" is
    the point listed before at the same time, or the last point an hour earlier. Only a
    point alone at two successive times matches then; that is decided from each time's
    first and last sample. ``per_point`` looks back within the point instead.
    """
    if per_point:
        w = Window.partitionBy("point_id").orderBy(*order)
        return samples.withColumn("pers_speed", F.lag("obs_speed").over(w))
    # Samples are unique per (time, point): within one time the previous sample is another
    # point. So only the first sample of a time can match, with the last of the time before.
    edges = samples.groupBy("valid_time").agg(
        F.min_by("point_id", "p_order").alias("first_point"),
        F.max_by("point_id", "p_order").alias("last_point"),
        F.max_by("obs_speed", "p_order").alias("last_speed"),
    )
    # One row per time step: two-level, so that no task sees more than a day plus the days' ends.
    w_day = Window.partitionBy(F.to_date("valid_time")).orderBy("valid_time")
    lagged = edges.select(
        "valid_time",
        "first_point",
        F.lag("last_point").over(w_day).alias("prev_point"),
        F.lag("last_speed").over(w_day).alias("prev_speed"),
        F.row_number().over(w_day).alias("rn"),
    )
    day_ends = edges.groupBy(F.to_date("valid_time").alias("day")).agg(
        F.max_by("last_point", "valid_time").alias("end_point"), F.max_by("last_speed", "valid_time").alias("end_speed")
    )
    # A row per calendar day.
    by_day = Window.orderBy("day")
    before = day_ends.select(
        "day", F.lag("end_point").over(by_day).alias("day_point"), F.lag("end_speed").over(by_day).alias("day_speed")
    )
    joined = lagged.withColumn("day", F.to_date("valid_time")).join(before, "day", "left")
    prev = joined.select(
        "valid_time",
        F.col("first_point").alias("point_id"),
        F.when(F.col("rn") == 1, F.col("day_point")).otherwise(F.col("prev_point")).alias("_pp"),
        F.when(F.col("rn") == 1, F.col("day_speed")).otherwise(F.col("prev_speed")).alias("_ps"),
    ).select("valid_time", "point_id", F.when(F.col("_pp") == F.col("point_id"), F.col("_ps")).alias("pers_speed"))
    return samples.join(prev, ["valid_time", "point_id"], "left")


__all__ = [
    "accuracy_report", "error_histogram", "last_pairs", "matched_pairs", "previous_observation",
    "promotion", "regime_scores", "score", "score_regime", "skill_pct", "validation_summary", "with_errors",
]
