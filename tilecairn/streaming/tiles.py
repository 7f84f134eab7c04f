"""Tiles from a stream of measured points: counts and sums a cell and time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilecairn.functions.mercator import point_to_cell


def cell_windows(points: DataFrame, zoom: int, window: str = "10 minutes", late: str = "1 hour", time: str = "ts", value: str = "value", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows window, block, count, sum, min, max of the points of a stream (or a table): tumbling windows that close when
    the watermark passes them. State is one row a cell and open window, not a row a point."""
    keyed = points.withWatermark(time, late).withColumn("block", point_to_cell(F.col(lon), F.col(lat), zoom))
    v = F.col(value)
    return keyed.groupBy(F.window(time, window).alias("window"), "block").agg(F.count(v).alias("count"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"))
