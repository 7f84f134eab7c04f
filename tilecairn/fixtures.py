"""Tables of tiles made from the tables of a data directory, which hold no rasters of their own.

Four consecutive embeddings are the quarters of a 16 x 16 tile; line items are points of a grid of tiles;
events are places; regions are zones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilecairn.functions.cells import tile_to_cell
from tilecairn.functions.pixels import encode
from tilecairn.operators.convert import array_tiles

SIZE, ZOOM, GRID_ZOOM, NODATA = 16, 8, 3, -9999.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tile_cell(t: Column) -> Column:
    """The cell of tile number t: numbers are spread over the world."""
    x = t % 256
    return tile_to_cell(x, (F.floor(t / 256) + 53 * x) % 256, ZOOM)


def _assemble_udf(nodata: float | None, turned: bool):
    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda quarters: _assembled(quarters, nodata, turned))

    return run


def _assembled(quarters, nodata: float | None, turned: bool) -> bytes:
    out = np.empty((SIZE, SIZE), np.float32)
    h = SIZE // 2
    for part in quarters:
        y, x = divmod(int(part["q"]), 2)
        v = np.asarray(part["embedding"], np.float32)
        out[y * h : y * h + h, x * h : x * h + h] = (v[::-1] if turned else v).reshape(h, h)
    if nodata is not None:
        out[out < 0] = nodata
    return encode(out, "float32")


def float_tiles(spark: SparkSession, sf_dir: str, nodata: float | None = None) -> DataFrame:
    """t, block, band_1 and band_2 (band_1 with the pixels of each quarter turned) as gzipped float32; with nodata,
    negative pixels are that."""
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    gathered = e.groupBy(F.floor(F.col("vec_id") / 4).alias("t")).agg(F.collect_list(F.struct((F.col("vec_id") % 4).alias("q"), "embedding")).alias("_q")).where(F.size("_q") == 4)
    return gathered.select("t", tile_cell(F.col("t")).alias("block"), _assemble_udf(nodata, False)("_q").alias("band_1"), _assemble_udf(nodata, True)("_q").alias("band_2"))


def grid_pixels(spark: SparkSession, sf_dir: str, month: bool = False) -> DataFrame:
    """block, _at, v: sums of quantities by pixel of the grid; by month, time_cf is its first day since 1992."""
    t = F.col("l_orderkey") % 64
    at = (F.col("l_suppkey") % SIZE * SIZE + F.col("l_partkey") % SIZE).cast("int")
    when = F.datediff(F.trunc(F.to_date("l_shipdate"), "month"), F.lit("1992-01-01").cast("date")).cast("double")
    by = [tile_to_cell(t % 8, F.floor(t / 8), GRID_ZOOM).alias("block"), at.alias("_at"), *([when.alias("time_cf")] if month else [])]
    return table(spark, sf_dir, "lineitem").groupBy(*by).agg(F.sum("l_quantity").alias("v"))


def grid_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block, band_1: int32, -32768 where no line item is."""
    return array_tiles(grid_pixels(spark, sf_dir), SIZE, "int32", ["v"], -32768)


def time_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block, time_cf, band_1 by month."""
    return array_tiles(grid_pixels(spark, sf_dir, True), SIZE, "int32", ["v"], -32768, by=("block", "time_cf"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with lon and lat."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").withColumn("lon", -180 + (e * 37 % 3600) / 10.0).withColumn("lat", -80 + (e * 91 % 1600) / 10.0)


def zone_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """zone, wkt: a band of longitudes for each region."""
    w = -180 + 72 * F.col("r_regionkey")
    text = F.format_string("POLYGON((%d -60, %d -60, %d 60, %d 60, %d -60))", w, w + 72, w + 72, w, w)
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("zone"), text.alias("wkt"))
