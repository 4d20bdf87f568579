"""Seasonal normals: statistics over a day-of-year window of the last years, per point.

Sums over a window are sums over its days, so the history is reduced once to partial sums
per (point, hour) and per (point, day), both with map-side combining. A sample needs whole
days after its cutoff, which come from the daily table, and the part of the cutoff day that
is not too old, which comes from the hourly one (the cutoff carries a time of day, and with
years of 365 days its day lies inside the window). Normals and frequency both work on the hourly
sums: a caller that needs both can store these once and hand them in as ``hourly``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmos.functions.common import rnd
from sparkmos.functions.wind import circular_mean

# --- Fixed values. ---
WINDOW_DAYS = 15
YEARS_BACK = 10
FOEHN_DAY_HPA = 8.0
FOEHN_MIN_DAYS = 30
NORMALS = {"wind_speed": "wind_speed_10m", "temp": "temperature_2m", "pressure": "pressure_msl"}
# --- End of fixed values. ---

PARTIALS = [
    "n_wind_speed", "s_wind_speed", "n_temp", "s_temp", "n_pressure", "s_pressure",
    "n_dir", "s_sin", "s_cos", "n_breva", "s_breva",
]


def hourly_partials(climatology: DataFrame) -> DataFrame:
    """Counts and sums per (point, timestamp)."""
    wd = F.radians("wind_direction_10m")
    breva = F.when(F.hour("timestamp").between(11, 16), F.col("wind_speed_10m"))
    aggs = [F.count("*").alias("n_rows")]
    for label, c in NORMALS.items():
        aggs += [F.count(c).alias(f"n_{label}"), F.sum(c).alias(f"s_{label}")]
    aggs += [
        F.count(wd).alias("n_dir"),
        F.sum(F.sin(wd)).alias("s_sin"),
        F.sum(F.cos(wd)).alias("s_cos"),
        F.count(breva).alias("n_breva"),
        F.sum(breva).alias("s_breva"),
    ]
    return climatology.groupBy("point_id", "timestamp").agg(*aggs)


def daily_partials(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("point_id", F.to_date("timestamp").alias("day")).agg(
        *[F.sum(c).alias(c) for c in PARTIALS]
    )


def _window(t: Column, window_days: int) -> tuple[Column, Column]:
    """Day-of-year window around ``t``, clamped at the ends of the year."""
    doy = F.dayofyear(t)
    return F.greatest(F.lit(1), doy - window_days), F.least(F.lit(366), doy + window_days)


def _with_cutoff(samples: DataFrame, years_back: int) -> DataFrame:
    return samples.withColumn("cutoff", F.col("t") - F.make_dt_interval(days=F.lit(365 * years_back)))


def _reach(times: DataFrame, window_days: int, years_back: int) -> Column:
    """Days of the year and cutoffs that the windows of any ``t`` lie between, as a scalar subquery."""
    lo, hi = _window(F.col("t"), window_days)
    ends = {"first_doy": F.min(lo), "last_doy": F.max(hi), "first_cutoff": F.min("cutoff"), "last_cutoff": F.max("cutoff")}
    return _with_cutoff(times.select("t"), years_back).agg(F.struct(*[c.alias(n) for n, c in ends.items()]).alias("r")).scalar()


def window_sums(
    samples: DataFrame, climatology: DataFrame, window_days: int = WINDOW_DAYS, years_back: int = YEARS_BACK, hourly: DataFrame | None = None
) -> DataFrame:
    """Summed partials per (point_id, t)."""
    hourly = hourly_partials(climatology) if hourly is None else hourly
    daily = daily_partials(hourly).withColumn("doy", F.dayofyear("day"))
    wanted = _with_cutoff(samples.select("point_id", "t").distinct(), years_back)
    lo, hi = _window(F.col("t"), window_days)

    # Whole days: one anchor per (point, day of t); all samples of a day share the sums.
    anchors = wanted.select("point_id", F.to_date("t").alias("t_day")).distinct()
    a_lo, a_hi = _window(F.col("t_day"), window_days)
    whole = (
        anchors.withColumn("doy", F.explode(F.sequence(a_lo, a_hi)))
        .join(daily, ["point_id", "doy"])
        .filter(F.col("day") > F.date_sub("t_day", 365 * years_back))
        .groupBy("point_id", "t_day")
        .agg(*[F.sum(c).alias(c) for c in PARTIALS])
    )
    # The cutoff day, from its cutoff on.
    edge = (
        wanted.withColumn("day", F.to_date("cutoff"))
        .filter(F.dayofyear("cutoff").between(lo, hi))
        .join(hourly.withColumn("day", F.to_date("timestamp")), ["point_id", "day"])
        .filter(F.col("timestamp") >= F.col("cutoff"))
        .groupBy("point_id", "t")
        .agg(*[F.sum(c).alias(f"e_{c}") for c in PARTIALS])
    )
    both = (
        wanted.withColumn("t_day", F.to_date("t"))
        .join(whole, ["point_id", "t_day"], "left")
        .join(edge, ["point_id", "t"], "left")
    )
    zero = F.lit(0)
    return both.select(
        "point_id", "t", *[(F.coalesce(c, zero) + F.coalesce(f"e_{c}", zero)).alias(c) for c in PARTIALS]
    )


def normals(
    samples: DataFrame, climatology: DataFrame, window_days: int = WINDOW_DAYS, years_back: int = YEARS_BACK, hourly: DataFrame | None = None
) -> DataFrame:
    """Normals of speed, temperature, pressure and direction, and the midday wind strength."""
    sums = window_sums(samples, climatology, window_days, years_back, hourly)

    def mean(label: str) -> Column:
        return F.when(F.col(f"n_{label}") > 0, F.col(f"s_{label}") / F.col(f"n_{label}"))

    return sums.select(
        "point_id",
        "t",
        *[mean(label).alias(f"climatology_{label}_normal") for label in NORMALS],
        F.when(F.col("n_dir") > 0, circular_mean(F.col("s_sin"), F.col("s_cos"))).alias("climatology_wind_dir_normal"),
        mean("breva").alias("climatology_breva_strength"),
    )


def foehn_frequency(
    times: DataFrame,
    climatology: DataFrame,
    north: str = "zurich",
    south: str = "milano_linate",
    window_days: int = WINDOW_DAYS,
    years_back: int = YEARS_BACK,
    hourly: DataFrame | None = None,
) -> DataFrame:
    """Share of days (percent) whose mean pressure difference reaches 8 hPa, per distinct ``t``.

    NULL unless the northern point has 30 days of data since the cutoff. The cutoff hour
    matters only on the cutoff day, whose mean is taken over its later part.
    """
    two = (hourly_partials(climatology) if hourly is None else hourly).filter(F.col("point_id").isin(north, south))
    of = lambda name, c: F.sum(F.when(F.col("point_id") == name, F.col(c)))
    zero = F.lit(0)
    hourly = two.groupBy("timestamp").agg(
        F.coalesce(of(north, "n_rows"), zero).alias("n_rows"),
        *[
            f.alias(f"{p}_{k}")
            for k, name in (("z", north), ("m", south))
            for p, f in (("n", F.coalesce(of(name, "n_pressure"), zero)), ("s", of(name, "s_pressure")))
        ],
    )
    parts = ["n_z", "s_z", "n_m", "s_m"]
    daily = hourly.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.sum("n_rows").alias("n_rows"), *[F.sum(p).alias(p) for p in parts]
    )
    paired = (F.col("n_z") > 0) & (F.col("n_m") > 0)
    foehn = F.col("s_z") / F.col("n_z") - F.col("s_m") / F.col("n_m") >= FOEHN_DAY_HPA
    counts = [
        F.count(F.when(paired, 1)).alias("n_days"),
        F.count(F.when(paired & foehn, 1)).alias("n_foehn"),
    ]
    wanted = _with_cutoff(times.select("t").distinct(), years_back)
    anchors = wanted.select(F.to_date("t").alias("t_day")).distinct()
    a_lo, a_hi = _window(F.col("t_day"), window_days)
    whole = (
        anchors.withColumn("doy", F.explode(F.sequence(a_lo, a_hi)))
        .join(daily.withColumn("doy", F.dayofyear("day")), "doy")
        .filter(F.col("day") > F.date_sub("t_day", 365 * years_back))
        .groupBy("t_day")
        .agg(*counts)
    )
    # Days with northern data after the cutoff day.
    days = daily.filter("n_rows > 0").select("day")
    later = anchors.select("t_day", F.date_sub("t_day", 365 * years_back).alias("cut_day"))
    n_later = _days_after(later, days)
    lo, hi = _window(F.col("t"), window_days)
    edge = (
        wanted.withColumn("day", F.to_date("cutoff"))
        .join(hourly.withColumn("day", F.to_date("timestamp")), "day")
        .filter(F.col("timestamp") >= F.col("cutoff"))
        .groupBy("t")
        .agg(F.sum("n_rows").alias("n_rows"), *[F.sum(p).alias(p) for p in parts])
        .select(
            "t",
            (F.col("n_rows") > 0).cast("int").alias("e_north"),
            (paired & F.dayofyear(F.col("t") - F.make_dt_interval(days=F.lit(365 * years_back))).between(lo, hi))
            .cast("int")
            .alias("e_days"),
            (foehn & paired).cast("int").alias("e_foehn"),
        )
    )
    n_days = F.coalesce("n_days", zero) + F.coalesce("e_days", zero)
    n_foehn = F.coalesce("n_foehn", zero) + F.coalesce("e_days", zero) * F.coalesce("e_foehn", zero)
    n_north = F.coalesce("n_later", zero) + F.coalesce("e_north", zero)
    share = F.when((n_north >= FOEHN_MIN_DAYS) & (n_days > 0), n_foehn / n_days * 100.0)
    return (
        wanted.withColumn("t_day", F.to_date("t"))
        .join(whole, "t_day", "left")
        .join(n_later, "t_day", "left")
        .join(edge, "t", "left")
        .select("t", rnd(share, 2).alias("climatology_foehn_frequency"), n_north.cast("bigint").alias("n_north_days"))
    )


def _days_after(anchors: DataFrame, days: DataFrame) -> DataFrame:
    """Number of rows of ``days`` later than each anchor's ``cut_day``.

    A running count over the calendar: one row per day of history, 36,525 in a century,
    which is what makes the unpartitioned window acceptable.
    """
    cuts = anchors.select(F.col("cut_day").alias("day"), F.lit(0).alias("n")).distinct()
    line = cuts.unionByName(days.select("day", F.lit(1).alias("n")))
    after = Window.orderBy(F.col("day").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # The range frame includes data of the cutoff day itself; take it off again.
    counted = line.groupBy("day").agg(F.max("n").alias("has"), F.min("n").alias("lowest")).select(
        "day", "lowest", (F.sum("has").over(after) - F.col("has")).alias("n_later")
    )
    return anchors.join(
        counted.filter("lowest = 0").select(F.col("day").alias("cut_day"), "n_later"), "cut_day", "left"
    ).select("t_day", "n_later")


def seasonal_percentile(
    samples: DataFrame,
    climatology: DataFrame,
    value: str = "fc_speed",
    window_days: int = WINDOW_DAYS,
    years_back: int = YEARS_BACK,
    times: DataFrame | None = None,
) -> DataFrame:
    """Percent of historical speeds in the window that lie below the sample's forecast.

    Whole days after the cutoff are the same for all samples of a point and day, so they are
    counted once per (point, day of the samples, distinct speed), and one running sum over a
    day's speeds serves all its samples. Only the cutoff day itself is read by the hour.

    History that no sample's window can touch is left out before it is counted or shuffled.
    ``times`` has the samples' times (others do no harm), where that is cheaper to ask.
    """
    wanted = _with_cutoff(samples.filter(F.col(value).isNotNull()).select("point_id", "t", F.col(value).alias("x")), years_back)
    wanted = wanted.withColumn("t_day", F.to_date("t"))
    speeds = climatology.filter("wind_speed_10m IS NOT NULL")
    reach = _reach(samples if times is None else times, window_days, years_back)
    in_days = F.dayofyear("timestamp").between(reach["first_doy"], reach["last_doy"])
    daily = speeds.filter(in_days).groupBy("point_id", F.to_date("timestamp").alias("day"), F.col("wind_speed_10m").alias("x")).agg(F.count("*").alias("n"))
    anchors = wanted.select("point_id", "t_day").distinct()
    a_lo, a_hi = _window(F.col("t_day"), window_days)
    whole = (
        anchors.withColumn("doy", F.explode(F.sequence(a_lo, a_hi)))
        .join(daily.withColumn("doy", F.dayofyear("day")), ["point_id", "doy"])
        .filter(F.col("day") > F.date_sub("t_day", 365 * years_back))
        .groupBy("point_id", "t_day", "x")
        .agg(F.sum("n").alias("n"))
    )
    # A sample stands before the history of its own speed: what is summed up to it lies below.
    line = whole.select("point_id", "t_day", "x", "n", F.lit(None).cast("timestamp_ntz").alias("t")).unionByName(
        wanted.select("point_id", "t_day", "x", F.lit(0).cast("long").alias("n"), "t")
    )
    of_day = Window.partitionBy("point_id", "t_day")
    upto = of_day.orderBy("x", F.col("t").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = line.withColumns({"below": F.sum("n").over(upto), "whole": F.sum("n").over(of_day)}).filter("t IS NOT NULL")
    lo, hi = _window(F.col("t"), window_days)
    on_cutoffs = (F.col("timestamp") >= reach["first_cutoff"]) & (F.to_date("timestamp") <= F.to_date(reach["last_cutoff"]))
    edge = (
        wanted.withColumn("day", F.to_date("cutoff"))
        .filter(F.dayofyear("cutoff").between(lo, hi))
        .join(speeds.filter(on_cutoffs).select("point_id", "timestamp", F.to_date("timestamp").alias("day"), "wind_speed_10m"), ["point_id", "day"])
        .filter(F.col("timestamp") >= F.col("cutoff"))
        .groupBy("point_id", "t")
        .agg(F.count("*").alias("e_all"), F.count(F.when(F.col("wind_speed_10m") < F.col("x"), 1)).alias("e_below"))
    )
    zero = F.lit(0)
    both = placed.join(edge, ["point_id", "t"], "left")
    n_below, n_all = F.col("below") + F.coalesce("e_below", zero), F.col("whole") + F.coalesce("e_all", zero)
    return both.filter(n_all > 0).select("point_id", "t", rnd(n_below / n_all * 100.0, 1).alias("seasonal_wind_percentile"))
