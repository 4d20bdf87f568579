"""Sustained-wind alerts and daily digests, as tables of what is due."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmos import settings as cfg
from sparkmos.functions.common import micros
from sparkmos.functions.timefn import in_quiet_hours, local, subscription_due
from sparkmos.operators.keyed import first_per_key
from sparkmos.operators.serve import hours_of_day, newest_order, prediction_at


def run_lengths(df: DataFrame, keys: Sequence[str], order: Sequence[Column], holds: Column, chunk: str) -> DataFrame:
    """Longest run of consecutive rows for which ``holds``, per key (0 when there is none).

    ``chunk`` names a column that only grows along the order, such as the valid time. Rows
    are numbered inside a chunk; a chunk is then reduced to its length, its leading and
    trailing run and its longest one, and only these summaries are put in sequence. A key
    with very many rows is thus never sorted in one task.
    """
    by = [*keys, chunk]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("_ok", F.coalesce(holds, F.lit(False))).withColumn("_run", F.sum((~F.col("_ok")).cast("int")).over(w))
    # Runs of a chunk: number 0 leads, the highest one trails.
    runs = rows.groupBy(*by, "_run").agg(F.count(F.when(F.col("_ok"), 1)).alias("_len"))
    chunks = runs.groupBy(*by).agg(
        F.max("_run").alias("_breaks"),
        F.max("_len").alias("_best"),
        F.max(F.when(F.col("_run") == 0, F.col("_len"))).alias("_lead"),
        F.max_by("_len", "_run").alias("_trail"),
    )
    upto = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = chunks.withColumn("_lead", F.coalesce("_lead", F.lit(0))).withColumn(
        "_id", F.sum((F.col("_breaks") > 0).cast("int")).over(upto)
    )
    # A chunk without a break lengthens the current run by its rows. One with a break ends
    # the run before it with its leading rows and opens the next with its trailing ones.
    piece = lambda i, n: F.struct(i.alias("_id"), n.alias("_n"))
    pieces = F.when(
        F.col("_breaks") > 0, F.array(piece(F.col("_id") - 1, F.col("_lead")), piece(F.col("_id"), F.col("_trail")))
    ).otherwise(F.array(piece(F.col("_id"), F.col("_best"))))
    across = joined.select(*keys, "_best", F.inline(pieces)).groupBy(*keys, "_id").agg(
        F.sum("_n").alias("_n"), F.max("_best").alias("_best")
    )
    return across.groupBy(*keys).agg(F.max(F.greatest("_n", "_best")).alias("max_run"))


def active(owned: DataFrame, users: DataFrame, *user_columns: str) -> DataFrame:
    """Enabled alerts or subscriptions with their owner's settings."""
    return owned.filter("enabled").join(users.select("telegram_user_id", *user_columns), "telegram_user_id")


def window_need(min_minutes: Column) -> Column:
    """Number of consecutive forecasts an alert asks for."""
    return F.greatest(F.lit(1), F.floor(min_minutes / 60))


def due_alerts(
    alerts: DataFrame,
    users: DataFrame,
    predictions: DataFrame,
    as_of: Column,
    *,
    latest_generation: bool = True,
    min_confidence: float | None = None,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Alerts to send at ``as_of``, with the peak of the lead window and its time.

    An alert is due when its owner is not in quiet hours, it did not fire within six hours
    and some run of consecutive forecasts in its lead window stays at its threshold. Rules
    of equal (point, threshold, lead) share one evaluation, whoever owns them.

    ``latest_generation`` evaluates one prediction per valid time, the newest, which also
    bounds a rule's series by its lead hours. Without it every stored generation counts.
    """
    ready = active(alerts, users, "timezone", "quiet_hours_start", "quiet_hours_end").filter(
        ~in_quiet_hours(local(as_of, F.col("timezone")), F.col("quiet_hours_start"), F.col("quiet_hours_end"))
        & F.coalesce(
            micros(as_of) - micros("last_triggered_at") >= cfg.ALERT_COOLDOWN_HOURS * 3600 * 1_000_000, F.lit(True)
        )
    )
    rule = ["point_id", "threshold_kn", "lead_window_hours"]
    rules = ready.select(*rule).distinct()
    future = predictions.filter((F.col("valid_time") >= as_of) & F.col("wind_speed_kn").isNotNull())
    if min_confidence is not None:
        future = future.filter(F.col("confidence_pct") >= min_confidence)
    if latest_generation:
        newest = [F.col("generated_at").desc(), *[F.col(c).desc() for c in tie_break]]
        future = first_per_key(future, ["point_id", "valid_time"], newest)
    future = future.select("point_id", "valid_time", "generated_at", "wind_speed_kn", *tie_break)
    ahead = rules.join(future, "point_id").filter(
        F.col("valid_time") <= as_of + F.make_dt_interval(hours=F.col("lead_window_hours"))
    )
    order = [F.col("valid_time"), F.col("generated_at").desc(), *[F.col(c).desc() for c in tie_break]]
    longest = run_lengths(ahead, rule, order, F.col("wind_speed_kn") >= F.col("threshold_kn"), chunk="valid_time")
    peak = ahead.groupBy(*rule).agg(
        F.max("wind_speed_kn").alias("peak_kn"),
        F.max_by("valid_time", F.struct("wind_speed_kn", -micros("valid_time"))).alias("peak_time"),
    )
    return (
        ready.join(longest.join(peak, rule), rule)
        .filter(F.col("max_run") >= window_need(F.col("min_duration_minutes")))
        .select("id", "telegram_user_id", *rule, "min_duration_minutes", "max_run", "peak_kn", "peak_time")
    )


def due_subscriptions(subscriptions: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    subs = active(subscriptions, users, "timezone")
    return subs.filter(
        subscription_due(
            local(as_of, F.col("timezone")), F.col("local_time"), local("last_sent_at", F.col("timezone"))
        )
    )


def best_midday(zones: DataFrame, points: DataFrame, predictions: DataFrame, as_of: Column, tie_break: Sequence[str] = ()) -> DataFrame:
    """Per time zone: the strongest predicted midday hour over all operational points."""
    names = points.select("point_id", "idx")
    zone_hours = hours_of_day(zones.select("timezone").distinct(), as_of, 11, 16, F.col("timezone"))
    # The operational points are a short configured list: one array, exploded per request.
    listed = names.agg(F.array_sort(F.collect_list(F.struct("idx", "point_id"))).alias("p")).scalar()
    targets = zone_hours.select("timezone", "hour", "target", F.inline(listed))
    at = prediction_at(targets, predictions, ["timezone", "point_id", "hour"], tie_break).filter("wind_speed_kn > 0")
    first = [F.col("wind_speed_kn").desc(), F.col("idx"), F.col("hour")]
    return first_per_key(at, ["timezone"], first).select(
        "timezone",
        F.col("point_id").alias("best_point"),
        F.col("hour").alias("best_hour"),
        F.col("wind_speed_kn").alias("best_speed"),
        (F.col("wind_speed_kn") >= cfg.SAIL_SPEED_KN).alias("go"),
    )


def digests(due: DataFrame, points: DataFrame, predictions: DataFrame, as_of: Column, tie_break: Sequence[str] = ()) -> DataFrame:
    """Due subscriptions with the day's best point and hour in the owner's zone."""
    return due.join(best_midday(due, points, predictions, as_of, tie_break), "timezone", "left")


def favourite_hours(owners: DataFrame, predictions: DataFrame, as_of: Column, tie_break: Sequence[str] = ()) -> DataFrame:
    """Hourly forecast 8 to 21 local of each distinct (timezone, favourite point)."""
    pairs = owners.select("timezone", F.col("favorite_point_id").alias("point_id")).distinct()
    targets = hours_of_day(pairs, as_of, 8, 21, F.col("timezone"))
    return prediction_at(targets, predictions, ["timezone", "point_id", "hour"], tie_break)


__all__ = [
    "active", "best_midday", "digests", "due_alerts", "due_subscriptions", "favourite_hours",
    "newest_order", "run_lengths", "window_need",
]
