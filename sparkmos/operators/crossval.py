"""Walk-forward windows and combinatorial purged cross-validation.

Windows, groups and paths are arithmetic on times and positions, so samples find theirs
without a join.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmos.functions.common import micros, rnd, ts

DAY_US = 86_400_000_000

# --- Fixed values: two-sided 5 % points of Student's t for 1 to 30 degrees of freedom. ---
T_975 = [
    12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139,
    2.200985, 2.178813, 2.160369, 2.144787, 2.131450, 2.119905, 2.109816, 2.100922, 2.093024, 2.085963,
    2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407, 2.045230, 2.042272,
]
Z_975 = 1.959964
# --- End of fixed values. ---


def n_windows(start: datetime, end: datetime, train_days: int, test_days: int, step_days: int) -> int:
    room = (end - start) - timedelta(days=train_days + test_days)
    return 0 if room < timedelta(0) else room // timedelta(days=step_days) + 1


def walk_forward_windows(spark: SparkSession, start: datetime, end: datetime, train_days: int, test_days: int, step_days: int) -> DataFrame:
    """Rolling-origin windows; a single one ending at ``end`` when none fits."""
    n = n_windows(start, end, train_days, test_days, step_days)
    t0, t1 = ts(start.isoformat(" ")), ts(end.isoformat(" "))
    days = lambda d: F.make_dt_interval(days=F.lit(d))
    if n == 0:
        cut = t1 - days(test_days)
        return spark.range(1).select(
            F.col("id").alias("window_id"), t0.alias("train_start"), cut.alias("train_end"),
            cut.alias("test_start"), t1.alias("test_end"),
        )
    shift = F.make_dt_interval(days=(F.col("id") * step_days).cast("int"))
    return spark.range(n).select(
        F.col("id").alias("window_id"),
        (t0 + shift).alias("train_start"),
        (t0 + shift + days(train_days)).alias("train_end"),
        (t0 + shift + days(train_days)).alias("test_start"),
        (t0 + shift + days(train_days + test_days)).alias("test_end"),
    )


def with_windows(samples: DataFrame, start: datetime, end: datetime, train_days: int, test_days: int, step_days: int, time: str = "valid_time") -> DataFrame:
    """Samples repeated for every test window they fall into (windows may overlap)."""
    n = n_windows(start, end, train_days, test_days, step_days)
    origin = ts((start + timedelta(days=train_days)).isoformat(" ")) if n else ts((end - timedelta(days=test_days)).isoformat(" "))
    since = micros(time) - micros(origin)
    step, test = step_days * DAY_US, test_days * DAY_US
    last = F.least(F.floor(since / step), F.lit(max(n, 1) - 1))
    first = F.greatest(F.floor((since - test) / step) + 1, F.lit(0))
    if n == 0:
        return samples.filter((since >= 0) & (since < test)).withColumn("window_id", F.lit(0).cast("bigint"))
    return samples.filter((since >= 0) & (first <= last)).withColumn("window_id", F.explode(F.sequence(first, last)))


def sample_index(samples: DataFrame, time: str = "valid_time", order: str = "p_order") -> DataFrame:
    """Position of every sample in (time, point order), from 0, without a global sort.

    Counts per time step are accumulated within each day and over the days (a row per
    calendar day); within a time step the rank is over its points.
    """
    per_time = samples.groupBy(time).agg(F.count("*").alias("n"))
    w_day = Window.partitionBy("day").orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    in_day = per_time.withColumn("day", F.to_date(time)).select(
        time, "day", F.coalesce(F.sum("n").over(w_day), F.lit(0)).alias("before_in_day")
    )
    w_days = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = per_time.groupBy(F.to_date(time).alias("day")).agg(F.sum("n").alias("n")).select(
        "day", F.coalesce(F.sum("n").over(w_days), F.lit(0)).alias("before_day")
    )
    offsets = in_day.join(days, "day").select(time, (F.col("before_in_day") + F.col("before_day")).alias("offset"))
    rank = F.row_number().over(Window.partitionBy(time).orderBy(order))
    return samples.withColumn("_r", rank).join(offsets, time).withColumn("idx", F.col("offset") + F.col("_r") - 1).drop("_r", "offset")


def group_of(idx: Column, n_samples: Column | int, n_groups: int) -> Column:
    """Contiguous groups of equal size; the last takes the remainder."""
    n = F.lit(n_samples) if isinstance(n_samples, int) else n_samples
    return F.least(F.floor(idx / F.floor(n / n_groups)), F.lit(n_groups - 1))


def paths(n_groups: int, n_test: int) -> list[tuple[int, ...]]:
    """Test groups of every path, in combination order."""
    return list(combinations(range(n_groups), n_test))


def paths_of_group(n_groups: int, n_test: int) -> Column:
    """Literal array: for every group, the paths that test on it."""
    combos = paths(n_groups, n_test)
    return F.array(*[F.array(*[F.lit(i) for i, c in enumerate(combos) if g in c]) for g in range(n_groups)])


def path_groups(spark: SparkSession, n_groups: int, n_test: int) -> DataFrame:
    """(path_id, grp) rows of the test groups."""
    table = paths_of_group(n_groups, n_test)
    return spark.range(n_groups).select(
        F.explode(F.get(table, F.col("id").cast("int"))).alias("path_id"), F.col("id").alias("grp")
    )


def purge_label(idx: Column, n_samples: Column | int, combo: Sequence[int], n_groups: int, purge: int, embargo: int) -> Column:
    """Label of a training sample for one path: ``purged``, ``embargo`` or ``train``.

    The first test position at or after ``idx - max(purge, embargo)`` decides: it removes
    the sample when it is at most ``purge`` ahead, as purged when within ``purge`` on either
    side, else as embargo. Group boundaries give that position directly.
    """
    n = F.lit(n_samples) if isinstance(n_samples, int) else n_samples
    size = F.floor(n / n_groups)
    reach = idx - max(purge, embargo)
    first = []
    for g in combo:
        start = size * g
        end = n if g == n_groups - 1 else size * (g + 1)
        at = F.greatest(start, reach)
        first.append(F.when(at <= end - 1, at))
    t = F.least(*first) if len(first) > 1 else first[0]
    return (
        F.when(t.isNull() | (t > idx + purge), F.lit("train"))
        .when(F.abs(idx - t) <= purge, F.lit("purged"))
        .otherwise(F.lit("embargo"))
    )


def group_spans(indexed: DataFrame, n_samples: Column | int, n_groups: int, time: str = "valid_time") -> Column:
    """First and last time of every group, as an array; a subquery of one row."""
    sized = indexed.select("idx", time).withColumn("_n", F.lit(n_samples) if isinstance(n_samples, int) else n_samples)
    grp = group_of(F.col("idx"), F.col("_n"), n_groups)
    mine = [F.when(grp == g, F.col(time)) for g in range(n_groups)]
    return sized.agg(F.array(*[F.struct(F.min(t).alias("first"), F.max(t).alias("last")) for t in mine]).alias("spans")).scalar()


def purge_label_by_time(time: Column, spans: Column, combo: Sequence[int], purge_hours: float, embargo_hours: float) -> Column:
    """Label by the clock: ``purged`` within ``purge_hours`` of a test group's time span, else
    ``embargo`` up to ``embargo_hours`` after one, else ``train``.

    Points interleave, so a group may end amid the samples of one time: those of the next
    group at that time are purged, as are all others too near whatever their position.
    """
    t, p, e = micros(time), int(purge_hours * 3_600_000_000), int(embargo_hours * 3_600_000_000)
    first = {g: micros(F.get(spans, F.lit(g))["first"]) for g in combo}
    last = {g: micros(F.get(spans, F.lit(g))["last"]) for g in combo}
    near, after = F.lit(False), F.lit(False)
    for g in combo:
        near = near | ((t >= first[g] - p) & (t <= last[g] + p))
        after = after | ((t > last[g]) & (t <= last[g] + e))
    return F.when(near, F.lit("purged")).when(after, F.lit("embargo")).otherwise(F.lit("train"))


def _labelled(indexed: DataFrame, n_samples: Column | int, n_groups: int, n_test: int, purge: float, embargo: float, by_time: str | None) -> tuple[DataFrame, list[Column]]:
    """``indexed`` with its size (and spans), and per path the label of a row, ``test`` included."""
    # The size may be a subquery; as a column it is planned once, not once per path.
    sized = indexed.withColumn("_n", F.lit(n_samples) if isinstance(n_samples, int) else n_samples)
    if by_time is not None:
        sized = sized.withColumn("_spans", group_spans(indexed, n_samples, n_groups, by_time))
    grp = group_of(F.col("idx"), F.col("_n"), n_groups)
    labels = []
    for c in paths(n_groups, n_test):
        if by_time is None:
            label = purge_label(F.col("idx"), F.col("_n"), c, n_groups, int(purge), int(embargo))
        else:
            label = purge_label_by_time(F.col(by_time), F.col("_spans"), c, purge, embargo)
        labels.append(F.when(grp.isin(*c), F.lit("test")).otherwise(label))
    return sized, labels


def training_labels(indexed: DataFrame, n_samples: Column | int, n_groups: int, n_test: int, purge: float, embargo: float, by_time: str | None = None) -> DataFrame:
    """One row per (path, sample outside its test groups) with its label.

    ``purge`` and ``embargo`` are positions, or hours if ``by_time`` names the time column.
    This is paths times samples; use ``label_counts`` when only the sizes matter.
    """
    sized, labels = _labelled(indexed, n_samples, n_groups, n_test, purge, embargo, by_time)
    per_path = F.array(*[F.struct(F.lit(i).alias("path_id"), label.alias("label")) for i, label in enumerate(labels)])
    return sized.select(*indexed.columns, F.inline(per_path)).filter("label <> 'test'")


def training_flags(indexed: DataFrame, n_samples: Column | int, n_groups: int, n_test: int, purge: float, embargo: float, by_time: str | None = None, out: str = "use") -> DataFrame:
    """``indexed`` with an array of flags: does path i train on the sample?"""
    sized, labels = _labelled(indexed, n_samples, n_groups, n_test, purge, embargo, by_time)
    return sized.select(*indexed.columns, F.array(*[label == "train" for label in labels]).alias(out))


def label_counts(indexed: DataFrame, n_samples: Column | int, n_groups: int, n_test: int, purge: float, embargo: float, by_time: str | None = None) -> DataFrame:
    """Training samples of every path by label: one pass over the samples, a sum per path and label."""
    kept = indexed.select("idx", *([by_time] if by_time else []))
    sized, per_path = _labelled(kept, n_samples, n_groups, n_test, purge, embargo, by_time)
    names = ("train", "purged", "embargo")
    sums = [F.count(F.when(label == lab, 1)).alias(f"{lab}_{i}") for i, label in enumerate(per_path) for lab in names]
    rows = [F.struct(F.lit(i).alias("path_id"), *[F.col(f"{lab}_{i}").alias(f"n_{lab}") for lab in names]) for i in range(len(per_path))]
    return sized.agg(*sums).select(F.inline(F.array(*rows)))


METRICS = {
    "cand_mae": "cand_err",
    "cand_dir": "cand_dir_err",
    "pers_mae": "pers_err",
    "nwp_mae": "nwp_err",
    "interval_coverage": "covered",
}


def path_scores(errors: DataFrame, n_samples: Column | int, n_groups: int, n_test: int) -> DataFrame:
    """Mean errors per path. Sums per group are taken once and shared by all its paths."""
    grp = group_of(F.col("idx"), n_samples, n_groups)
    sums = errors.groupBy(grp.alias("grp")).agg(
        *[f.alias(f"{p}_{m}") for m, c in METRICS.items() for p, f in (("s", F.sum(c)), ("n", F.count(c)))]
    )
    per_path = sums.join(path_groups(errors.sparkSession, n_groups, n_test), "grp").groupBy("path_id").agg(
        *[F.sum(f"{p}_{m}").alias(f"{p}_{m}") for m in METRICS for p in ("s", "n")]
    )
    scale = {"interval_coverage": 100.0}
    return per_path.filter("n_cand_mae > 0").select(
        "path_id",
        F.col("n_cand_mae").alias("n_test"),
        *[(F.col(f"s_{m}") / F.nullif(F.col(f"n_{m}"), F.lit(0)) * scale.get(m, 1.0)).alias(m) for m in METRICS],
    )


def scores_by_path(errors: DataFrame) -> DataFrame:
    """Mean errors per path, for errors that carry ``path_id`` because every path has a model of its own."""
    scale = {"interval_coverage": 100.0}
    found = errors.groupBy("path_id").agg(F.count("cand_err").alias("n_test"), *[(F.avg(c) * scale.get(m, 1.0)).alias(m) for m, c in METRICS.items()])
    return found.filter("n_test > 0")


def t_critical(df: Column) -> Column:
    """Two-sided 5 % point; beyond the table a series in 1/df."""
    z = Z_975
    series = z + (z**3 + z) / 4 / df + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / (df * df)
    table = F.get(F.array(*[F.lit(v) for v in T_975]), (df - 1).cast("int"))
    return F.when(df <= len(T_975), table).otherwise(series)


def summarize_paths(path_scores_df: DataFrame) -> DataFrame:
    """Mean and population deviation over paths, gains, and a one-sample t-test."""
    diff = F.col("nwp_mae") - F.col("cand_mae")
    s = path_scores_df.agg(
        F.count("*").alias("n_paths"),
        F.sum("n_test").alias("n_test_samples"),
        *[f(m).alias(f"{m}_{n}") for m in METRICS for n, f in (("mean", F.avg), ("std", F.stddev_pop))],
        F.avg(diff).alias("_d"),
        F.stddev_samp(diff).alias("_sd"),
    )
    t = F.col("_d") / (F.col("_sd") / F.sqrt("n_paths"))
    better = F.when(F.col("n_paths") >= 5, t > t_critical(F.col("n_paths") - 1)).otherwise(
        F.col("cand_mae_mean") < F.col("nwp_mae_mean")
    )

    def gain(base: str) -> Column:
        return F.when(F.col(base) > 0, (1.0 - F.col("cand_mae_mean") / F.col(base)) * 100.0).otherwise(F.lit(0.0))

    digits = {"cand_mae": 3, "pers_mae": 3, "nwp_mae": 3, "cand_dir": 2, "interval_coverage": 2}
    return s.select(
        "n_paths",
        "n_test_samples",
        *[rnd(F.coalesce(f"{m}_{n}", F.lit(0.0)), d).alias(f"{m}_{n}") for m, d in digits.items() for n in ("mean", "std")],
        rnd(gain("nwp_mae_mean"), 2).alias("improvement_vs_nwp_pct"),
        rnd(F.when(F.col("pers_mae_mean").isNotNull(), gain("pers_mae_mean")).otherwise(0.0), 2).alias("improvement_vs_persistence_pct"),
        t.alias("t_statistic"),
        F.coalesce(better, F.lit(False)).alias("is_significant"),
    )
