"""Points, areas and other rasters against tiles: values, clips, region statistics, joins."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilecairn.functions import mercator as merc
from tilecairn.functions.cells import parent, tile_of
from tilecairn.functions.geometry import Area, Cover, cover, parse_wkt, pixel_mask
from tilecairn.functions.pixels import decode, valid
from tilecairn.functions.stats import FIELDS, STATS, frame, merged_of, summary, summary_udf
from tilecairn.plans.ranges import MOST_RANGES, in_cover, in_ranges
from tilecairn.plans.scratch import cut
from tilecairn.sources.metadata import band_type
from tilecairn.sources.tables import read_metadata, read_table

#: Bytes up to which ids, ranges or places are broadcast, once they have been written and counted; beyond, they are
#: joined by shuffles, or not at all where that spares the blobs.
BROADCAST_BYTES = 64 << 20


def value_udf(kind: str, size: int, nodata=None, compression: str | None = None):
    """A function of a blob, px and py that gives the pixel's value; nodata and null blobs give null."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for blob, px, py in parts:
            out = np.full(len(blob), np.nan)
            last, values, good = None, None, None
            for i, (b, x, y) in enumerate(zip(blob, px, py, strict=True)):
                if b is None or x != x or y != y:
                    continue
                if b is not last:
                    last, values = b, decode(b, kind, compression)
                    good = valid(values, nodata)
                at = int(y) * size + int(x)
                if good[at]:
                    out[i] = values[at]
            yield pd.Series(out).astype(object).where(~np.isnan(out), None)

    return run


def pixel_of(lon: Column, lat: Column, zoom: int, size: int) -> tuple[Column, Column]:
    """The pixel of a point in its tile."""
    x, y = merc.fraction_x(lon, zoom), merc.fraction_y(F.greatest(F.lit(-merc.EDGE), F.least(lat, F.lit(merc.EDGE))), zoom)
    place = lambda f, t: F.greatest(F.lit(0), F.least(F.lit(size - 1), F.floor((f - t) * size).cast("int")))
    return place(x, merc.tile_x(lon, zoom)), place(y, merc.tile_y(lat, zoom))


def values_at(points: DataFrame, tiles: DataFrame, band: str, kind: str, zoom: int, size: int, nodata=None, lon: str = "lon", lat: str = "lat", compression: str | None = None) -> DataFrame:
    """points with columns block and value: the pixel under each, null where the table has no tile.

    The distinct pixels that are asked for are gathered by tile first, size^2 a tile at most, written and counted;
    then a blob meets them once and is decoded once. Up to BROADCAST_BYTES they go to the blobs, which stay
    where they are; only beyond that blobs are shuffled, without those of tiles that nobody asks for.
    """
    x, y = pixel_of(F.col(lon), F.col(lat), zoom, size)
    asked = points.withColumn("block", merc.point_to_cell(F.col(lon), F.col(lat), zoom)).withColumn("_px", x).withColumn("_py", y)
    places = cut(asked.where("block is not null").groupBy("block").agg(F.collect_set((F.col("_py") * size + F.col("_px")).cast("int")).alias("_at")))
    n = places.agg(F.sum(F.size("_at") * 4 + 16)).first()[0] or 0
    read = tiles.select("block", F.col(band).alias("_blob")).join(F.broadcast(places) if n <= BROADCAST_BYTES else places, "block")
    found = read.mapInArrow(partial(_values, kind=kind, size=size, nodata=nodata, compression=compression), "block long, _px int, _py int, value double")
    return asked.join(found, ["block", "_px", "_py"], "left").drop("_px", "_py")


def table_values(spark: SparkSession, path: str, points: DataFrame, band: str | None = None, zoom: int | None = None, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """values_at() for a table, whose metadata tell type, nodata and size: at its finest zoom, or at a zoom that is
    taken to the nearest one that the table has."""
    meta = read_metadata(spark, path)
    t, entry = meta["tiling"], band_type(meta, band or meta["bands"][0]["name"])
    z = t["max_zoom"] if zoom is None else max(t["min_zoom"], min(t["max_zoom"], zoom))
    tiles = read_table(spark, path, [entry["name"]], z)
    return values_at(points, tiles, entry["name"], entry["type"], z, t["block_width"], entry.get("nodata"), lon, lat, meta.get("compression"))


def _values(batches, kind: str, size: int, nodata, compression: str | None):
    """Rows block, _px, _py, value from rows of block, _blob and places."""
    for batch in batches:
        for block, blob, at in zip(batch.column("block").to_pylist(), batch.column("_blob"), batch.column("_at"), strict=True):
            if not blob.is_valid:
                continue
            values, at = decode(blob.as_py(), kind, compression), at.values.to_numpy()
            good = valid(values, nodata)[at]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array((at % size).astype(np.int32)), pa.array((at // size).astype(np.int32)), pa.array(values[at].astype("f8"), mask=~good)], ["block", "_px", "_py", "value"])


def masked_stats_udf(area: Area, kind: str, size: int, nodata=None, compression: str | None = None, found: Cover | None = None):
    """A function of a block and a blob that gives the STATS of the pixels whose centre lies in the area. With a cover
    of the area, tiles outside it give nulls without being decoded, and tiles wholly inside need no mask."""

    @F.pandas_udf(STATS)
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for blocks, blobs in parts:
            at = found.place(blocks.to_numpy()) if found is not None else np.zeros(len(blocks), int)
            out: list[dict | None] = []
            for c, b, i in zip(blocks, blobs, at.tolist(), strict=True):
                if b is None or i < 0:
                    out.append(None)
                    continue
                whole = found is not None and found.inside[i]
                out.append(summary(decode(b, kind, compression), nodata, mask=None if whole else pixel_mask(area, *tile_of(int(c)), size)))
            yield frame(out)

    return run


def region_stats(tiles: DataFrame, band: str, kind: str, area: Area, zoom: int, size: int, nodata=None, stored: bool = False, compression: str | None = None) -> DataFrame:
    """One row: count, sum, mean, min, max and stddev of the pixels whose centre lies in the area.

    The area becomes a few ranges of ids for the reader; which tiles lie within them is found out where the
    pixels are. Tiles wholly inside are taken as they are; with ``stored`` statistics those give theirs without
    their pixels being read. Tiles give partial sums, so pixels are never shuffled.
    """
    found = cover(area, zoom)
    if not stored:
        masked = masked_stats_udf(area, kind, size, nodata, compression, found)
        return tiles.where(in_ranges(F.col("block"), found.merged(MOST_RANGES))).select(masked("block", band).alias("s")).agg(*merged_of("s"))
    edge = found.part(False)
    masked = masked_stats_udf(area, kind, size, nodata, compression, edge)
    inner = tiles.where(in_cover(F.col("block"), found.part(True))).select(stored_stats(band).alias("s"))
    outer = tiles.where(in_ranges(F.col("block"), edge.merged(MOST_RANGES))).select(masked("block", band).alias("s"))
    return inner.unionAll(outer).agg(*merged_of("s"))


def stored_stats(band: str) -> Column:
    """STATS of a tile from its stored statistics columns."""
    c = lambda n: F.col(f"{band}_{n}")
    squares = c("count") * (c("stddev") * c("stddev") + c("mean") * c("mean"))
    return F.struct(c("count"), c("sum"), c("mean"), c("min"), c("max"), c("stddev"), squares).cast(STATS)


def clip(tiles: DataFrame, band: str, kind: str, area: Area, zoom: int, size: int, nodata=None, compression: str | None = None) -> DataFrame:
    """Rows block, px, py, value: the valid pixels whose centre lies in the area."""

    @F.pandas_udf("array<struct<px:int,py:int,value:double>>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for blocks, blobs in parts:
            out = []
            for c, b in zip(blocks, blobs, strict=True):
                if b is None:
                    out.append([])
                    continue
                values = decode(b, kind, compression)
                at = np.flatnonzero(valid(values, nodata) & pixel_mask(area, *tile_of(int(c)), size))
                out.append([{"px": int(i % size), "py": int(i // size), "value": float(values[i])} for i in at])
            yield pd.Series(out)

    met = tiles.where(in_ranges(F.col("block"), cover(area, zoom).merged(MOST_RANGES)))
    return met.select("block", F.explode(run("block", band)).alias("p")).select("block", "p.px", "p.py", "p.value")


def covering(zones: DataFrame, zoom: int, zone: str = "zone", wkt: str = "wkt", mode: str = "intersects") -> DataFrame:
    """Rows zone, first, last, inside: for every zone the ranges of cells that it meets."""

    @F.pandas_udf("array<struct<first:bigint,last:bigint,inside:boolean>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: [] if t is None else [{"first": a, "last": b, "inside": c} for a, b, c in cover(parse_wkt(t), zoom, mode).ranges])

    return zones.select(F.col(zone).alias("zone"), F.explode(run(wkt)).alias("r")).select("zone", "r.first", "r.last", "r.inside")


def zone_blocks(tiles: DataFrame, zones: DataFrame, zoom: int, zone: str = "zone", wkt: str = "wkt") -> DataFrame:
    """Rows zone, block, inside, written: the tiles that each zone meets. Only ids are joined.

    The areas become ranges of cells, each the descendants of one ancestor; a tile looks up its ancestors at
    the zooms that ranges have, so the join is by equality, neither a comparison of all pairs nor a list of
    all cells. The ranges are written first; only if they have been counted and are small they are broadcast.
    """
    span = F.col("last") - F.col("first") + 1
    up = F.when(F.col("first") == F.col("last"), F.lit(zoom)).otherwise((F.lit(26) - F.bround(F.log2(span.cast("double")) / 2)).cast("int"))
    ranges = cut(covering(zones, zoom, zone, wkt).withColumn("_up", up).select("zone", "inside", "_up", parent(F.col("first"), F.col("_up")).alias("_anchor")))
    sizes = ranges.groupBy("_up").agg(F.count("*").alias("n")).collect()  # at most 27 rows
    ups = F.array(*(F.lit(r["_up"]) for r in sizes)) if sizes else F.array().cast("array<int>")
    small = 64 * sum(r["n"] for r in sizes) <= BROADCAST_BYTES
    keyed = tiles.select("block", F.explode(ups).alias("_up")).withColumn("_anchor", parent(F.col("block"), F.col("_up")))
    return cut(keyed.join(F.broadcast(ranges) if small else ranges, ["_up", "_anchor"]).select("zone", "block", "inside"))


def zonal_stats(tiles: DataFrame, zones: DataFrame, band: str, kind: str, zoom: int, size: int, nodata=None, zone: str = "zone", wkt: str = "wkt", compression: str | None = None, stored: bool = False) -> DataFrame:
    """Statistics of every zone: zone, count, sum, mean, min, max, stddev; the join of rasters with areas.

    First only ids meet the zones (zone_blocks()). A tile wholly inside some zones is summarised once for all
    of them, without a mask, or not at all with ``stored`` statistics. A tile on a boundary meets its zones, in
    groups of ZONES_AT_ONCE, as one row, and is decoded once for each group. Ids go to the blobs by a broadcast
    if they were counted and are few. With very many, tiles wholly inside are summarised without a join, and
    only tiles on boundaries are shuffled. A zone without a valid pixel has no row.
    """
    met = zone_blocks(tiles, zones, zoom, zone, wkt)
    inner, outer = met.where("inside"), met.where("not inside")
    n = met.groupBy("inside").agg(F.count_distinct("block").alias("n")).collect()  # two rows
    blocks = {r["inside"]: r["n"] for r in n}
    whole = tiles
    if 16 * blocks.get(True, 0) <= BROADCAST_BYTES:
        whole = tiles.join(F.broadcast(inner.select("block").distinct()), "block", "left_semi")
    per_tile = whole.select("block", (stored_stats(band) if stored else summary_udf(kind, nodata, compression)(band)).alias("s"))
    of_inner = inner.join(per_tile, "block").select("zone", "s")

    texts = zones.select(F.col(zone).alias("zone"), F.col(wkt).alias("wkt"))
    part = F.pmod(F.xxhash64("zone"), F.ceil(F.col("_n") / ZONES_AT_ONCE))
    counts = outer.groupBy("block").agg(F.count("*").alias("_n"))
    grouped = outer.join(counts, "block").withColumn("_part", part).join(texts, "zone").groupBy("block", "_part").agg(F.collect_list(F.struct("zone", "wkt")).alias("_zones"))
    grouped = cut(grouped)
    weight = grouped.agg(F.sum(16 + F.aggregate("_zones", F.lit(0), lambda a, z: a + 16 + F.octet_length(z["wkt"]) + F.octet_length(z["zone"].cast("string"))))).first()[0] or 0
    masked = tiles.select("block", F.col(band).alias("_blob")).join(F.broadcast(grouped) if weight <= BROADCAST_BYTES else grouped, "block")
    kind_of = zones.schema[zone].dataType.simpleString()
    of_outer = masked.mapInArrow(partial(_masked, kind=kind, size=size, nodata=nodata, compression=compression), f"zone {kind_of}, s {STATS}")
    return of_inner.unionByName(of_outer).where("s.count is not null").groupBy("zone").agg(*merged_of("s"))


#: Zones that one decoded tile is masked for.
ZONES_AT_ONCE = 64


def _masked(batches, kind: str, size: int, nodata, compression: str | None):
    """Rows zone, s (STATS) from rows of block, _blob and zones."""
    areas: dict[str, Area] = {}
    for batch in batches:
        found, names = [], []
        for block, blob, zones in zip(batch.column("block").to_pylist(), batch.column("_blob"), batch.column("_zones").to_pylist(), strict=True):
            if not blob.is_valid:
                continue
            values = decode(blob.as_py(), kind, compression)
            for z in zones:
                if z["wkt"] not in areas:
                    if len(areas) > 10_000:
                        areas.clear()
                    areas[z["wkt"]] = parse_wkt(z["wkt"])
                names.append(z["zone"])
                found.append(summary(values, nodata, mask=pixel_mask(areas[z["wkt"]], *tile_of(block), size)) or dict.fromkeys(FIELDS))
        if found:
            kinds = pa.struct([(f, pa.int64() if f == "count" else pa.float64()) for f in FIELDS])
            yield pa.RecordBatch.from_arrays([pa.array(names, batch.schema.field("_zones").type.value_type.field("zone").type), pa.array(found, kinds)], ["zone", "s"])


def raster_join(a: DataFrame, b: DataFrame, zoom_a: int | None = None, zoom_b: int | None = None) -> DataFrame:
    """Tiles of two tables side by side by block (and time, if both have it); where zooms differ, tiles of the
    finer table meet the ancestor in the coarser one. Columns of b that a has too get the end _b."""
    keys = [k for k in ("block", "time_cf") if k in a.columns and k in b.columns]
    named = b.select(*(F.col(c) if c in keys or c not in a.columns else F.col(c).alias(f"{c}_b") for c in b.columns))
    if zoom_a is None or zoom_b is None or zoom_a == zoom_b:
        return a.join(named, keys)
    if zoom_a < zoom_b:
        return a.join(named.withColumnRenamed("block", "block_b").withColumn("block", parent(F.col("block_b"), zoom_a)), keys)
    return a.withColumn("_up", parent(F.col("block"), zoom_b)).join(named.withColumnRenamed("block", "block_b"), (F.col("_up") == F.col("block_b"))).drop("_up")
