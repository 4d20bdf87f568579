"""Conformal calibration: exact score quantiles per (target, quantile), or any other groups.

The needed quantile is an order statistic whose rank follows from the group's size, a column
here. A sketch brackets it first (of a small group, all scores are taken); then the rows below
the bracket are counted and only the distinct scores inside it are ranked, so no large group is
sorted in one task. It is one plan, whatever the number of groups, and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SKETCH = 10_000


def level(n: Column, alpha: float) -> Column:
    return F.least(F.ceil((n + 1) * (1 - alpha)) / n, F.lit(1.0))


def score_quantiles(scores: DataFrame, group: Sequence[str], alpha: float = 0.1, min_n: int = 100) -> DataFrame:
    """``q_hat`` per group of ``score``: the conformal level, interpolated linearly.

    Groups below ``min_n`` scores give no row.
    """
    group = list(group)
    known = scores.select(*group, "score").filter("score IS NOT NULL")
    # From SKETCH scores on, the level is within 2 / SKETCH of 1 - alpha, its two positions within
    # as much again of it, and the sketch errs by no more than 1 / SKETCH.
    around = [max(0.0, 1 - alpha - 5 / SKETCH), min(1.0, 1 - alpha + 5 / SKETCH)]
    sizes = known.groupBy(*group).agg(
        F.count("*").alias("_n"), F.min("score").alias("_min"), F.max("score").alias("_max"),
        F.percentile_approx("score", F.array(*map(F.lit, around)), SKETCH).alias("_b"),
    )
    small = F.col("_n") < SKETCH
    position = level(F.col("_n"), alpha) * (F.col("_n") - 1)
    bracket = sizes.filter(F.col("_n") >= min_n).select(
        *group, F.col("_n").alias("n_calibration"), position.alias("_pos"),
        F.when(small, F.col("_min")).otherwise(F.get("_b", F.lit(0))).alias("_lo"),
        F.when(small, F.col("_max")).otherwise(F.get("_b", F.lit(1))).alias("_hi"),
    )
    marked = known.join(bracket, group).filter(F.col("score") <= F.col("_hi"))
    # All rows below the bracket are one entry, of no score.
    entry = F.when(F.col("score") >= F.col("_lo"), F.col("score"))
    entries = marked.groupBy(*group, "n_calibration", "_pos", entry.alias("_score")).agg(F.count("*").alias("_k"))
    upto = Window.partitionBy(*group).orderBy(F.col("_score").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = entries.withColumn("_last", F.sum("_k").over(upto))  # ranks last - k to last - 1 hold this score
    at = lambda k: F.max(F.when((F.col("_last") - F.col("_k") <= k) & (F.col("_last") > k), F.col("_score")))
    low = F.floor("_pos")
    ends = ranked.groupBy(*group, "n_calibration", "_pos").agg(at(low).alias("_a"), at(F.ceil("_pos")).alias("_z"))
    return ends.select(*group, "n_calibration", (F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("_pos") - low)).alias("q_hat"))


def scores_of(predicted: DataFrame, quantiles: Sequence[float], normalized: str | None = None) -> DataFrame:
    """Long (target, quantile, score) of absolute errors, from bias columns and targets.

    ``normalized`` names the expected error: scores are then in units of the scale by which
    ``decision.conformal_shift`` multiplies the quantile again.
    """
    scale = F.lit(1.0) if normalized is None else F.when(F.col(normalized) >= 0.1, F.col(normalized) / 0.1).otherwise(F.lit(1.0))
    items = [
        F.struct(
            F.lit(t).alias("target"),
            F.lit(q).alias("quantile"),
            (F.abs(F.col(f"target_{t}") - F.col(f"bias_{t}_q{round(q * 100):02d}")) / scale).alias("score"),
        )
        for t in ("u", "v")
        for q in quantiles
    ]
    return predicted.select(F.inline(F.array(*items))).filter("score IS NOT NULL")
