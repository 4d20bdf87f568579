"""The compass ring around a point, and a gridded field from scattered points."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmos import settings as cfg
from sparkmos.functions import geo, wind
from sparkmos.functions.common import rnd
from sparkmos.operators.asof import reference_forecast
from sparkmos.settings import Point
from sparkmos.sources.points import inline_points

# --- Fixed values: opposite directions of the ring. ---
AXES = {"ns": ("N", "S"), "ew": ("E", "W"), "nesw": ("NE", "SW"), "nwse": ("NW", "SE")}
RING_FIELDS = {
    "wind_speed": "wind_speed_kn",
    "wind_dir": "wind_dir_deg",
    "pressure": "pressure_msl",
    "temperature": "temperature_2m",
}
# --- End of fixed values. ---
KM_PER_DEGREE = 111.1  # of latitude, and of longitude on the equator; a little less than either


def ring_sources(centres: DataFrame, points: Sequence[Point], radius_km: float = 20.0, max_km: float = 25.0) -> DataFrame:
    """For every ring position of every centre: the nearest stored point within ``max_km``.

    Points and positions meet in cells of the globe whose edges are at least ``max_km`` long;
    a position looks into its own cell and those around it. Works up to 85 degrees latitude.
    """
    ring = centres.select(
        F.col("point_id").alias("centre_id"), F.inline(geo.compass_ring(F.col("lat"), F.col("lon"), radius_km))
    )
    edge_lat = max_km / KM_PER_DEGREE
    columns = max(1, math.floor(360.0 * KM_PER_DEGREE * math.cos(math.radians(85)) / max_km))
    row = lambda lat: F.floor(lat / edge_lat)
    column = lambda lon: F.floor((lon + 180.0) / 360.0 * columns)
    beside = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    stored = centres.sparkSession.range(1).select(F.inline(inline_points(points)))
    stored = stored.select("point_id", "p_lat", "p_lon", row(F.col("p_lat")).alias("_y"), F.pmod(column(F.col("p_lon")), F.lit(columns)).alias("_x"))
    looks = ring.withColumn("_dy", F.explode(beside)).withColumn("_dx", F.explode(beside)).select(
        "centre_id", "direction", "lat", "lon", (row(F.col("lat")) + F.col("_dy")).alias("_y"),
        F.pmod(column(F.col("lon")) + F.col("_dx"), F.lit(columns)).alias("_x"),
    ).distinct()
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))
    near = looks.join(stored, ["_y", "_x"]).withColumn("km", km).filter(F.col("km") <= max_km)
    best = near.groupBy("centre_id", "direction").agg(F.min(F.struct("km", "point_id")).alias("_near"))
    return best.select("centre_id", "direction", F.col("_near.point_id").alias("point_id"), F.col("_near.km").alias("km"))


def ring_forecasts(
    centres: DataFrame, times: DataFrame, forecasts: DataFrame, points: Sequence[Point], radius_km: float = 20.0,
    max_km: float = 25.0, tie_break: Sequence[str] = (),
) -> DataFrame:
    """Per (centre, t, direction) the reference forecast at the nearest stored point.

    The stored points used are few, so the lookup runs once per (point, t) and is then
    fanned out to the ring positions that use it.
    """
    sources = ring_sources(centres, points, radius_km, max_km)
    used = sources.select("point_id").distinct()
    requests = times.select("t").distinct().select("t", F.inline(inline_points(points))).select("t", "point_id")
    requests = requests.join(used, "point_id", "left_semi")
    found = reference_forecast(requests, forecasts, list(RING_FIELDS.values()), 60, cfg.REFERENCE_MODEL, tie_break=tie_break)
    return found.join(sources, "point_id").select(
        F.col("centre_id").alias("point_id"), "t", "direction", *[F.col(c).alias(n) for n, c in RING_FIELDS.items()]
    )


def ring_features(ring: DataFrame, keys: Sequence[str] = ("point_id", "t")) -> DataFrame:
    """Gradients across the ring and statistics along it, per sample."""
    at = lambda d, f: F.max(F.when(F.col("direction") == d, F.col(f)))
    rim = lambda f: F.when(F.col("direction") != "center", F.col(f))
    rad = F.radians(rim("wind_dir"))
    aggs = [
        F.count(rim("pressure")).alias("n_p"),
        F.stddev_pop(rim("pressure")).alias("sd_p"),
        F.avg(rim("pressure")).alias("mean_p"),
        at("center", "pressure").alias("center_p"),
        F.count(rad).alias("n_d"),
        F.sum(F.sin(rad)).alias("sum_sin"),
        F.sum(F.cos(rad)).alias("sum_cos"),
        F.count(rim("wind_speed")).alias("n_s"),
        (F.max(rim("wind_speed")) - F.min(rim("wind_speed"))).alias("range_s"),
        F.avg(rim("wind_speed")).alias("mean_s"),
    ]
    for field, short in (("pressure", "pressure"), ("temperature", "temp")):
        aggs += [(at(a, field) - at(b, field)).alias(f"_{short}_{axis}") for axis, (a, b) in AXES.items()]
    g = ring.groupBy(*keys).agg(*aggs)
    out: dict[str, Column] = {
        f"grid_{short}_grad_{axis}": rnd(F.col(f"_{short}_{axis}"), 2) for short in ("pressure", "temp") for axis in AXES
    }
    n_p, n_d, n_s = F.col("n_p"), F.col("n_d"), F.col("n_s")
    out |= {
        "grid_pressure_std": rnd(F.when(n_p >= 4, F.col("sd_p")), 3),
        "grid_pressure_laplacian": rnd(F.when(n_p >= 6, F.col("mean_p") - F.col("center_p")), 3),
        "grid_wind_dir_circvar": rnd(
            F.when(n_d >= 4, wind.circular_variance(F.col("sum_sin"), F.col("sum_cos"), n_d)), 4
        ),
        "grid_wind_speed_range": rnd(F.when(n_s >= 4, F.col("range_s")), 2),
        "grid_wind_speed_mean": rnd(F.when(n_s >= 4, F.col("mean_s")), 2),
    }
    return g.select(*keys, *[c.alias(n) for n, c in out.items()])


def gridded_field(
    located: DataFrame,
    keys: Sequence[str],
    *,
    lon: tuple[float, float],
    lat: tuple[float, float],
    resolution: int = 150,
    power: float = 2.0,
    value: str = "wind_speed_kn",
    mask: bool = True,
) -> DataFrame:
    """Inverse-distance field on a regular grid, per key (for instance per valid time).

    Values at the same place are summed first, since they share their weights. Every place
    is then spread over the grid's columns, these are dealt out, and each task sums the cells
    of its columns. Work is places times cells; the number of cells is fixed. With ``mask``
    only cells on the water are kept.
    """

    def axis(lo: float, hi: float, index: Column) -> Column:
        return lo + (hi - lo) / (resolution - 1) * index

    steps = F.sequence(F.lit(0), F.lit(resolution - 1))
    places = (
        located.filter(F.col(value).isNotNull())
        .groupBy(*keys, "lat", "lon")
        .agg(F.sum(value).alias("_v"), F.count("*").alias("_n"))
    )
    # Columns of the grid are dealt out before they become cells: few bytes, much work behind
    # them, so their number is given. The sums below need no other shuffle.
    parts = int(located.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    strips = places.withColumn("ix", F.explode(steps)).repartition(parts, *keys, "ix")
    cells = strips.withColumn("iy", F.explode(steps))
    x, y = axis(*lon, F.col("ix")), axis(*lat, F.col("iy"))
    d2 = F.pow(x - F.col("lon"), 2) + F.pow(y - F.col("lat"), 2)
    # A value on the cell itself dominates instead of dividing by zero.
    w = F.pow(F.greatest(d2, F.lit(1e-12)), F.lit(-power / 2.0))
    sums = cells.groupBy(*keys, "ix", "iy").agg(
        F.sum(w * F.col("_v")).alias("_wv"), F.sum(w * F.col("_n")).alias("_w")
    )
    field = sums.select(
        *keys, "ix", "iy", x.alias("lon"), y.alias("lat"), (F.col("_wv") / F.col("_w")).alias(value)
    )
    return field.filter(geo.inside_polygon(F.col("lon"), F.col("lat"))) if mask else field
