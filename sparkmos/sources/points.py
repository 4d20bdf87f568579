"""The point dimension."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmos.settings import POINTS, Point


def points_df(spark: SparkSession, points: Sequence[Point] = POINTS) -> DataFrame:
    """Points as an inline table, so the optimizer knows its exact (small) size."""
    rows = ", ".join(
        f"({i}L, '{p.point_id}', {p.lat}D, {p.lon}D, {str(p.is_operational).lower()})" for i, p in enumerate(points)
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(idx, point_id, lat, lon, is_operational)")


def operational(points: DataFrame) -> DataFrame:
    return points.filter("is_operational")


def inline_points(points: Sequence[Point]) -> Column:
    """The points as one literal array of structs, whatever their number."""
    rows = json.dumps([{"point_id": p.point_id, "p_lat": p.lat, "p_lon": p.lon} for p in points])
    return F.from_json(F.lit(rows), "array<struct<point_id: string, p_lat: double, p_lon: double>>")
