"""From pixels to a table: tiles, statistics, overviews, metadata, layout."""

from __future__ import annotations

import math
from collections.abc import Iterator
from enum import StrEnum

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilecairn.functions import mercator as merc
from tilecairn.functions.cells import cell_x, cell_y, checked_block_size, tile_to_cell
from tilecairn.functions.pixels import LOSSY, encode, interleave_udf, plain_udf
from tilecairn.functions.stats import merged_of_columns, stat_columns, summary_udf
from tilecairn.operators.pyramid import pyramid
from tilecairn.plans.ranges import in_zoom
from tilecairn.plans.scratch import remove
from tilecairn.sources import metadata as M
from tilecairn.sources.tables import GROUP_ROWS, rows_for, scan, write_table


class ZoomStrategy(StrEnum):
    AUTO = "auto"
    LOWER = "lower"
    UPPER = "upper"


class Overviews(StrEnum):
    AUTO = "auto"
    NONE = "none"


class Codec(StrEnum):
    GZIP = "gzip"
    NONE = "none"
    JPEG = "jpeg"
    WEBP = "webp"


class Layout(StrEnum):
    SEQUENTIAL = "sequential"
    INTERLEAVED = "interleaved"


def pixel_tiles(pixels: DataFrame, zoom: int, size: int, kind: str, values: list[str], nodata=None, lon: str = "lon", lat: str = "lat", how: str = "average", compression: str | None = "gzip") -> DataFrame:
    """Tiles of a zoom from rows of lon, lat and values: each pixel is an aggregate (average, min, max, sum, count)
    of the values whose point falls in it. Pixels without a value are nodata.

    The first aggregation is by pixel, with partial sums, so however many points fall on one place, a tile
    then gathers at most size^2 pixels.
    """
    checked_block_size(size)
    x, y = merc.fraction_x(F.col(lon), zoom), merc.fraction_y(F.col(lat), zoom)
    place = lambda f, t: F.greatest(F.lit(0), F.least(F.lit(size - 1), F.floor((f - t) * size))).cast("int")
    tx, ty = merc.tile_x(F.col(lon), zoom), merc.tile_y(F.col(lat), zoom)
    by = {"average": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}[how]
    keyed = pixels.select(tile_to_cell(tx, ty, zoom).alias("block"), (place(y, ty) * size + place(x, tx)).alias("_at"), *values)
    grouped = keyed.groupBy("block", "_at").agg(*(by(v).cast("double").alias(f"_{i}") for i, v in enumerate(values)))
    return array_tiles(grouped, size, kind, [f"_{i}" for i in range(len(values))], nodata, compression)


def array_tiles(pixels: DataFrame, size: int, kind: str, values: list[str], nodata=None, compression: str | None = "gzip", by: tuple[str, ...] = ("block",)) -> DataFrame:
    """Tiles from rows of block, _at (the place of a pixel) and values: columns band_1, band_2, ..."""

    @F.pandas_udf("binary")
    def fill(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda got: _filled(got, size, kind, nodata, compression))

    gathered = pixels.groupBy(*by).agg(*(F.collect_list(F.struct("_at", F.col(v).alias("v"))).alias(f"_c{i}") for i, v in enumerate(values)))
    return gathered.select(*by, *(fill(f"_c{i}").alias(f"band_{i + 1}") for i in range(len(values))))


def _filled(got, size: int, kind: str, nodata, compression: str | None) -> bytes:
    out = np.full(size * size, nodata if nodata is not None else np.nan if kind[0] == "f" else 0, "f8")
    for p in got:
        if p["v"] is not None and p["v"] == p["v"]:
            out[p["_at"]] = p["v"]
    return encode(out if kind[0] == "f" else np.rint(out), kind, compression)


def with_statistics(tiles: DataFrame, bands: list[str], kind: str, nodata=None, compression: str | None = None, outliers: bool = False) -> DataFrame:
    """tiles with the statistics columns of each band."""
    run = summary_udf(kind, nodata, compression, outliers)
    named = tiles.select("*", *(run(b).alias(f"_s_{b}") for b in bands))
    return named.select(*tiles.columns, *(c for b in bands for c in stat_columns(F.col(f"_s_{b}"), b)))


def dimensions(tiles: DataFrame, zoom: int, size: int) -> DataFrame:
    """One row: width, height, west, south, east, north and blocks of a zoom."""
    x, y = cell_x(F.col("block")), cell_y(F.col("block"))
    r = tiles.where(in_zoom(F.col("block"), zoom)).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.count_distinct("block").alias("blocks"))
    return r.select(((F.col("x1") - F.col("x0") + 1) * size).alias("width"), ((F.col("y1") - F.col("y0") + 1) * size).alias("height"), merc.west(F.col("x0"), zoom).alias("west"), merc.north(F.col("y1") + 1, zoom).alias("south"), merc.west(F.col("x1") + 1, zoom).alias("east"), merc.north(F.col("y0"), zoom).alias("north"), "blocks")


def build_table(spark: SparkSession, native: DataFrame, path: str, kind: str, zoom: int, size: int, least_zoom: int | None = None, overviews: Overviews = Overviews.AUTO, resampling: str = "average", layout: Layout = Layout.SEQUENTIAL, compression: str | None = "gzip", tile_statistics: bool = True, nodata=None, group_rows: int = GROUP_ROWS, file_bytes: int = 0, bands: dict | None = None, time: dict | None = None, own: dict[int, DataFrame] | None = None, quality: int | None = None, footer: dict[str, str] | None = None, keep_empty: bool = False, **more) -> dict:
    """Write a table of native tiles (block, band_1, ...) with overviews and metadata; gives the metadata.

    Tiles without a valid pixel are left out, unless ``keep_empty``. Pixels are decoded once: statistics are computed as tiles are
    written, and the metadata's come from the written statistics columns of the finest zoom, exactly. ``own`` holds
    overviews that the source has itself, ``footer`` entries for the footers of the files, ``more`` further fields
    of the metadata.
    """
    checked_block_size(size)
    names = [c for c in native.columns if c.startswith("band_")]
    if compression in LOSSY and layout != Layout.INTERLEAVED:
        raise ValueError(f"{compression} needs the interleaved layout")
    if least_zoom is None:
        d = dimensions(native, zoom, size).first()
        least_zoom = zoom if d["blocks"] == 0 else max(0, zoom - max(0, round(math.log2(math.hypot(d["width"], d["height"]) / merc.LEAST_OVERVIEW))))
    tiles = native if overviews == Overviews.NONE else pyramid(native, names, kind, size, zoom, least_zoom, resampling, nodata, "gzip", own)
    if layout == Layout.SEQUENTIAL and compression in (None, "none"):
        tiles = tiles.select(*(c for c in tiles.columns if c not in names), *(plain_udf(kind)(b).alias(b) for b in names))
    counted = with_statistics(tiles, names, kind, nodata)
    if not keep_empty:
        counted = counted.where(" or ".join(f"{b}_count > 0" for b in names))
    stat = [f"{b}{s}" for b in names for s in M.SUFFIXES]
    kept = [c for c in counted.columns if c not in names and c not in stat]
    if layout == Layout.INTERLEAVED:
        counted = counted.select(*kept, interleave_udf(kind, compression, quality or 85)(F.array(*names)).alias("pixels"), *stat)
    staged = f"{path.rstrip('/')}.staged"
    counted.write.mode("overwrite").parquet(staged)
    done = spark.read.schema(counted.schema).parquet(staged)
    d = dimensions(done, zoom, size).first()
    finest = done.where(in_zoom(F.col("block"), zoom))
    entries = []
    for b in names:
        s = finest.agg(*merged_of_columns(b)).first().asDict()
        s["valid_percent"] = 100.0 * (s["count"] or 0) / max(1, d["blocks"] * size * size)
        entries.append(M.Band(b, kind, nodata, statistics=s, **(bands or {}).get(b, {})))
    meta = M.document(entries, [d["west"], d["south"], d["east"], d["north"]], d["width"], d["height"], zoom if overviews == Overviews.NONE else least_zoom, zoom, size, d["blocks"], compression, str(layout), quality=quality, tile_statistics=tile_statistics, time=time, **more)
    final = done if tile_statistics else done.drop(*stat)
    files = 0
    if file_bytes:
        blob = "pixels" if layout == Layout.INTERLEAVED else names[0]
        r = done.agg(F.count("*").alias("n"), F.sum(F.octet_length(blob)).alias("b")).first()
        files = rows_for(file_bytes, (r["b"] or 0) * (1 if layout == Layout.INTERLEAVED else len(names)), r["n"])
    write_table(final, path, meta, group_rows, files, footer=footer)
    remove(spark, staged)
    return meta

