"""Layouts of tables: by zoom, by ancestor, by bytes; and choosing among candidates by budget."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilecairn.functions import cells
from tilecairn.sources import metadata as M
from tilecairn.sources.tables import GROUP_ROWS, _order, read_metadata, read_table

#: Bytes that a file of a partitioned table aims at.
TARGET_BYTES = 128 << 20


def zoom_counts(tiles: DataFrame) -> DataFrame:
    """Rows zoom, tiles."""
    return tiles.groupBy(cells.resolution(F.col("block")).alias("zoom")).agg(F.count("*").alias("tiles"))


def blob_bytes(tiles: DataFrame, bands: list[str]) -> Column:
    return F.sum(sum((F.coalesce(F.octet_length(b), F.lit(0)) for b in bands), F.lit(0)).cast("long"))


def partition_zoom(native: int, tiles: int, size: int, target: int = TARGET_BYTES) -> int | None:
    """partition_zoom_of() for numbers on the driver."""
    if not tiles:
        return None
    z = max(0, min(native - 1, round(native - math.log(max(1.0, target / max(1.0, size / tiles)), 4))))
    return z if tiles / 4 ** (native - z) >= 2 else None


def partition_zoom_of(native: Column | int, tiles: Column, size: Column, target: int = TARGET_BYTES) -> Column:
    """The ancestor zoom at which files come near the target: the native zoom less log4 of the tiles that fill a
    file, rounded half to even, from 0 to native - 1; null where that would give fewer than two files."""
    top = native if isinstance(native, Column) else F.lit(native)
    up = F.log(F.greatest(F.lit(1.0), F.lit(float(target)) / F.greatest(F.lit(1.0), size / tiles))) / math.log(4.0)
    z = F.greatest(F.lit(0), F.least(top - 1, F.bround(top - up).cast("int")))
    return F.when((tiles > 0) & (tiles / F.pow(F.lit(4.0), top - z) >= 2), z)


def with_ancestor(tiles: DataFrame, zoom: int) -> DataFrame:
    """tiles with part_cell, the ancestor at a zoom, and part_file, its name z{zoom}_{x}_{y}."""
    p = cells.parent(F.col("block"), zoom)
    return tiles.withColumn("part_cell", p).withColumn("part_file", F.concat(F.lit(f"z{zoom}_"), cells.cell_x(p), F.lit("_"), cells.cell_y(p)))


def partition_summary(tiles: DataFrame, bands: list[str], zoom: int) -> DataFrame:
    """Rows part_file, tiles, bytes of each partition by ancestor."""
    return with_ancestor(tiles, zoom).groupBy("part_file").agg(F.count("*").alias("tiles"), blob_bytes(tiles, bands).alias("bytes"))


def size_summary(parts: DataFrame) -> DataFrame:
    """One row of partition_summary(): files, least, most and mean bytes."""
    return parts.agg(F.count("*").alias("files"), F.min("bytes").alias("least"), F.max("bytes").alias("most"), F.avg("bytes").alias("mean"))


def _standalone(tiles: DataFrame, key: str, path: str, meta: dict, patch, group_rows: int) -> None:
    """Write tiles partitioned by a key so that each part is a table by itself, with a metadata row of its own.

    A part's rows are dealt over as many tasks as its bytes ask for (by ranges of block within the part), so
    one large part is not one task.
    """
    by = _order(tiles)
    data = tiles.withColumn("metadata", F.lit(None).cast("string"))
    options = {"compression": "zstd", "parquet.block.row.count.limit": str(group_rows)}
    data.repartitionByRange(key, *by).sortWithinPartitions(key, *by).write.partitionBy(key).options(**options).parquet(path)
    counts = tiles.groupBy(key).agg(F.count("*").alias("_n"), F.min(cells.resolution(F.col("block"))).alias("_a"), F.max(cells.resolution(F.col("block"))).alias("_b"))
    text = F.lit(json.dumps(meta | {"tiling": None}))
    patched = patch(F.col("_n"), F.col("_a"), F.col("_b"))
    whole = F.regexp_replace(text, '"tiling": null', F.concat(F.lit('"tiling": '), F.to_json(patched, {"ignoreNullFields": "false"})))
    rows = counts.select(key, F.lit(0).cast("long").alias("block"), whole.alias("metadata"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in data.schema if f.name not in (key, "block", "metadata")))
    rows.write.partitionBy(key).options(**options).mode("append").parquet(path)


def _tiling(meta: dict):
    t = meta["tiling"]
    return lambda n, a, b: F.struct(*(F.lit(v).alias(k) for k, v in t.items() if k not in ("min_zoom", "max_zoom", "num_blocks")), a.alias("min_zoom"), b.alias("max_zoom"), n.alias("num_blocks"))


def split_by_zoom(spark: SparkSession, path: str, to: str, group_rows: int = GROUP_ROWS) -> None:
    """Rewrite a table as a folder a zoom (zoom=5/...), each a table by itself."""
    meta = read_metadata(spark, path)
    tiles = read_table(spark, path).withColumn("zoom", cells.resolution(F.col("block")))
    _standalone(tiles, "zoom", to, meta, _tiling(meta), group_rows)


def partition(spark: SparkSession, path: str, to: str, zoom: int | None = None, target: int = TARGET_BYTES, group_rows: int = GROUP_ROWS) -> int | None:
    """Rewrite the finest zoom of a table as a folder an ancestor (part_file=z3_1_2/...), each a table by itself.
    Gives the ancestor zoom, by default partition_zoom(); None where the table is small enough for one."""
    meta = read_metadata(spark, path)
    native = meta["tiling"]["max_zoom"]
    tiles = read_table(spark, path, zoom=native)
    if zoom is None:
        row = tiles.agg(F.count("*").alias("n"), blob_bytes(tiles, M.band_columns(tiles)).alias("b"))
        zoom = row.select(partition_zoom_of(native, F.col("n"), F.coalesce("b", F.lit(0)), target).alias("z")).first()["z"]
    placed = with_ancestor(tiles, zoom if zoom is not None else 0).drop("part_cell")
    if zoom is None:
        placed = placed.withColumn("part_file", F.lit("z0_0_0"))
    _standalone(placed, "part_file", to, meta, _tiling(meta), group_rows)
    return zoom


def file_splits(tiles: DataFrame, bands: list[str], target: int) -> DataFrame:
    """Rows file, tiles, bytes: the files that a byte budget cuts the sorted tiles into; a file takes tiles while
    its bytes before them are below the budget of the files so far. A report over sizes by block.

    Running totals are taken in two steps, within ranges of ids and over the ranges' totals, of which there are
    a fixed number, so no window spans the table.
    """
    size = sum((F.coalesce(F.octet_length(b), F.lit(0)) for b in bands), F.lit(0)).cast("long")
    sized = tiles.select(F.col("block"), size.alias("size")).withColumn("bin", cells.right(F.col("block"), 44))
    inner = Window.partitionBy("bin").orderBy("block")
    before = F.sum("size").over(inner) - F.col("size")
    bins = sized.groupBy("bin").agg(F.sum("size").alias("total"))
    outer = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.select("bin", F.coalesce(F.sum("total").over(outer), F.lit(0)).alias("start"))
    placed = sized.withColumn("before", before).join(starts, "bin").withColumn("file", F.floor((F.col("start") + F.col("before")) / target))
    return placed.groupBy("file").agg(F.count("*").alias("tiles"), F.sum("size").alias("bytes"))


def newest(df: DataFrame, by: list[str], date: str, size: str) -> DataFrame:
    """Of each group the row with the latest date, then the largest size."""
    best = F.max_by(F.struct(*df.columns), F.struct(date, size))
    return df.groupBy(*by).agg(best.alias("_r")).select("_r.*")


def within_budget(df: DataFrame, order: list[Column], size: str, budget: float, groups: str) -> DataFrame:
    """In each group the rows, in order, whose running total of sizes stays within a budget."""
    w = Window.partitionBy(groups).orderBy(*order)
    return df.withColumn("running", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("running") <= budget)


def greedy(sizes: list[float], budget: float) -> list[int]:
    """Places of the sizes that greedy_rows() would take, for a list on the driver."""
    out, left = [], budget
    for i, s in enumerate(sizes):
        if s <= left:
            out.append(i)
            left -= s
    return out


def greedy_rows(df: DataFrame, order: list[str], size: str, budget: float, groups: str) -> DataFrame:
    """In each group the rows that are taken one after the other, in order, while they fit a budget; what doesn't is
    passed over. For candidates, of which a group has a list that fits a row."""
    listed = df.groupBy(groups).agg(F.sort_array(F.collect_list(F.struct(*order, F.struct(*df.columns).alias("row")))).alias("_all"))
    take = lambda s, c: F.when(c["row"][size] <= s["left"], F.struct((s["left"] - c["row"][size]).alias("left"), F.concat(s["rows"], F.array(c["row"])).alias("rows"))).otherwise(s)
    kind = f"array<{df.select(F.struct(*df.columns).alias('r')).schema['r'].dataType.simpleString()}>"
    start = F.struct(F.lit(float(budget)).alias("left"), F.array().cast(kind).alias("rows"))
    return listed.select(F.explode(F.aggregate("_all", start, take, lambda s: s["rows"])).alias("r")).select("r.*")
