"""Reading tables of tiles, and writing them so that readers can prune by block."""

from __future__ import annotations

import json
import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilecairn.functions.cells import cell_of
from tilecairn.functions.geometry import Area, auto_zoom
from tilecairn.functions.mercator import tile_at
from tilecairn.plans.ranges import in_zoom, intersects
from tilecairn.plans.scratch import remove
from tilecairn.sources import metadata as M

#: Rows of a row group: what a point query reads.
GROUP_ROWS = 200


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a table with block as BIGINT. Unsigned 64-bit blocks come as decimals and are cast, which
    readers cannot prune by; normalize() rewrites such a table once."""
    df = spark.read.parquet(path)
    return df if dict(df.dtypes)["block"] == "bigint" else df.withColumn("block", F.col("block").cast("long"))


def read_metadata(spark: SparkSession, path: str) -> dict:
    """The metadata; of several rows, as partitioned sets have, any. Only that row group is read."""
    row = scan(spark, path).where("block = 0 and metadata is not null").select("metadata").limit(1).first()
    return M.parse(row and row["metadata"])


def read_table(spark: SparkSession, path: str, bands: list[str] | None = None, zoom: int | None = None, metadata: bool = False) -> DataFrame:
    """The tiles, without the metadata row; of chosen bands only, of one zoom only. With ``metadata``, the table's
    metadata stands on every row, as a literal."""
    df = scan(spark, path).where(F.col("block") != 0).drop("metadata")
    df = df if zoom is None else df.where(in_zoom(F.col("block"), zoom))
    if bands is not None:
        kept = {"block", "time_cf", "time_ts", *bands, *(b + s for b in bands for s in M.SUFFIXES)}
        df = df.select(*(c for c in df.columns if c in kept))
    return df.withColumn("metadata", F.lit(json.dumps(read_metadata(spark, path)))) if metadata else df


def metadata_table(spark: SparkSession, path: str) -> DataFrame:
    """The metadata as one row: its text, size, zooms, and bands."""
    shape = "width long, height long, crs string, bounds array<double>, compression string, band_layout string, tiling struct<min_zoom:int,max_zoom:int,pixel_zoom:int,block_width:int,block_height:int,num_blocks:long>, bands array<struct<name:string,type:string,nodata:string,description:string,unit:string,colorinterp:string>>"
    text = F.lit(json.dumps(read_metadata(spark, path)))
    return spark.range(1).select(text.alias("metadata"), F.from_json(text, shape).alias("m")).select("metadata", *(f"m.{c}" for c in ("width", "height", "crs", "bounds", "compression", "band_layout")), "m.tiling.*", "m.bands")


def read_region(spark: SparkSession, path: str, area: Area, zoom: int | str | None = None, bands: list[str] | None = None) -> DataFrame:
    """The tiles that an area meets. zoom: a number (taken to the nearest that the table has), "max" (as None),
    "min", or "auto" (the finest at which the area's box spans 64 tiles at most)."""
    t = read_metadata(spark, path)["tiling"]
    least, most = t["min_zoom"], t["max_zoom"]
    z = {None: most, "max": most, "min": least}.get(zoom, zoom)
    z = auto_zoom(area, least, most) if z == "auto" else max(least, min(most, int(z)))
    return read_table(spark, path, bands).where(intersects(F.col("block"), area, z))


def read_at(spark: SparkSession, path: str, lon: float, lat: float, zoom: int | None = None, bands: list[str] | None = None) -> DataFrame:
    """The tile under a point: one literal id, so one row group is read."""
    t = read_metadata(spark, path)["tiling"]
    z = t["max_zoom"] if zoom is None else max(t["min_zoom"], min(t["max_zoom"], zoom))
    return read_table(spark, path, bands).where(F.col("block") == cell_of(*tile_at(lon, lat, z), z))


def read_tile(spark: SparkSession, path: str, x: int, y: int, z: int, bands: list[str] | None = None) -> DataFrame:
    """A tile by its place, as tile servers ask for it."""
    return read_table(spark, path, bands).where(F.col("block") == cell_of(x, y, z))


def _order(df: DataFrame) -> list[str]:
    return ["block", "time_cf"] if "time_cf" in df.columns else ["block"]


#: Entries in the footers of a table's files.
FOOTER = {"tiles:version": M.VERSION}
#: File systems that the sink with footers can write to; on others Spark's writer does, without them.
ARROW_SCHEMES = ("file", "hdfs", "s3", "s3a", "s3n", "gs", "abfs", "abfss")


def write_table(tiles: DataFrame, path: str, meta: dict, group_rows: int = GROUP_ROWS, file_rows: int = 0, compression: str = "zstd", partition_by: list[str] | None = None, mode: str = "error", footer: dict[str, str] | None = None) -> None:
    """Write tiles sorted by block (and time) in range partitions, in row groups of so many rows, and then the
    metadata row as a file of its own, so that no data row group begins at block 0.

    Files have a page index, block as their sorting column and the footer entries (FOOTER by default).
    ``file_rows`` bounds the rows of a file (rows_for() gives it from a byte budget). With ``partition_by`` a folder
    a value is written, by ranges of block within it, so that a large one is not one task; by Spark's writer.
    """
    spark, by = tiles.sparkSession, _order(tiles)
    data = tiles if "metadata" in tiles.columns else tiles.select("block", F.lit(None).cast("string").alias("metadata"), *(c for c in tiles.columns if c != "block"))
    options = {"compression": compression, "parquet.block.row.count.limit": str(group_rows)} | ({"maxRecordsPerFile": str(file_rows)} if file_rows else {})
    if partition_by:
        dealt = data.repartitionByRange(*partition_by, *by).sortWithinPartitions(*partition_by, *by)
        dealt.write.partitionBy(*partition_by).options(**options).mode(mode).parquet(path)
        M.metadata_row(data.drop(*partition_by), meta).coalesce(1).write.options(**options).mode("append").parquet(f"{path}/{'/'.join(f'{c}=0' for c in partition_by)}")
        return
    dealt, row = data.repartitionByRange(*by).sortWithinPartitions(*by), M.metadata_row(data, meta).coalesce(1)
    scheme = re.match(r"(\w+):", path)
    if scheme and scheme[1] not in ARROW_SCHEMES:
        dealt.write.options(**options).mode(mode).parquet(path)
        row.write.options(**options).mode("append").parquet(path)
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        if mode == "overwrite":
            remove(spark, path)
        elif mode != "append":
            raise FileExistsError(f"{path} exists")
    from tilecairn.sources.grids import TileSink

    spark.dataSource.register(TileSink)
    entries = {f"footer.{k}": v for k, v in (FOOTER if footer is None else footer).items()}
    for part in (dealt, row):
        part.write.format("tile_files").options(path=path, group_rows=group_rows, file_rows=file_rows, compression=compression, **entries).mode("append").save()


def rows_for(bytes_per_file: int, blob_bytes: int, rows: int) -> int:
    """Rows of a file for a byte budget, from the bytes of all blobs."""
    return max(1, int(bytes_per_file // max(1, blob_bytes / max(1, rows))))


def normalize(spark: SparkSession, path: str, to: str) -> None:
    """Rewrite a table once with BIGINT blocks, in order, with present metadata."""
    write_table(scan(spark, path).where("block <> 0").drop("metadata"), to, read_metadata(spark, path))


@lru_cache(maxsize=256)
def _cached(spark: SparkSession, path: str, stamp: int) -> dict:
    return read_metadata(spark, path)


def cached_metadata(spark: SparkSession, path: str) -> dict:
    """read_metadata(), kept until the table's folder changes."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return _cached(spark, path, p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime())
