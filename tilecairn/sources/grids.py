"""Raster files as Spark data sources: ASCII grids in, tables with footer entries out."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileType
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tilecairn.sources.rasters import _directories, _tiff_image, grid_index, open_at, open_image

PIXELS = "lon double, lat double, value double"


@dataclass
class Rows(InputPartition):
    first: int
    last: int


class GridSource(DataSource):
    """format("ascii_grid"): rows lon, lat, value of an ASCII grid in degrees, without nodata values, on any file system
    that Arrow knows. Option rows_per_partition (1000). The driver reads the file once to note where rows
    begin, so that a partition reads but its own."""

    @classmethod
    def name(cls) -> str:
        return "ascii_grid"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema: StructType) -> DataSourceReader:
        return GridReader(self.options["path"], int(self.options.get("rows_per_partition", 1000)))


class GridReader(DataSourceReader):
    def __init__(self, path: str, step: int):
        self.path, self.step = path, step
        system, where = open_at(path)
        with system.open_input_file(where) as f:
            self.index = grid_index(f)

    def partitions(self) -> list[InputPartition]:
        rows = int(self.index[0]["nrows"])
        return [Rows(i, min(rows, i + self.step)) for i in range(0, rows, self.step)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        image = open_image(self.path, index=self.index)
        lon = image.origin[0] + (np.arange(image.width) + 0.5) * image.step[0]
        for top in range(partition.first, partition.last, image.EVERY):
            bottom = min(partition.last, top + image.EVERY)
            v = image.window(top, bottom, 0, image.width)[0].astype(float)
            lat = image.origin[1] + (np.arange(top, bottom) + 0.5) * image.step[1]
            good = v != image.nodata
            columns = (np.broadcast_to(lon, v.shape)[good], np.broadcast_to(lat[:, None], v.shape)[good], v[good])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["lon", "lat", "value"])


@dataclass
class Written(WriterCommitMessage):
    paths: tuple[str, ...]


class TileSink(DataSource):
    """format("tile_files"): writes each partition as Parquet files with a sorting column, a page index, row groups of
    ``group_rows``, ``file_rows`` rows a file at most (0: all) and footer entries (options that begin with
    "footer."), which Spark's own writer can't write. The path is on any file system that Arrow knows."""

    @classmethod
    def name(cls) -> str:
        return "tile_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return TileWriter(dict(self.options))


class TileWriter(DataSourceArrowWriter):
    """Files are named by the job, so that a job only ever removes files of its own."""

    def __init__(self, options: dict[str, str]):
        self.path, self.rows, self.most = options["path"], int(options.get("group_rows", 200)), int(options.get("file_rows", 0))
        self.compression, self.job = options.get("compression", "zstd"), uuid.uuid4().hex
        self.footer = {k[7:]: v for k, v in options.items() if k.startswith("footer.")}

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, folder = open_at(self.path)
        system.create_dir(folder, recursive=True)
        task, paths, out, held, in_file = TaskContext.get(), [], None, [], 0

        def flush(last: bool) -> None:
            nonlocal out, held, in_file
            while held and (last or sum(b.num_rows for b in held) >= self.rows):
                table = pa.Table.from_batches(held)
                room = min(self.rows, self.most - in_file) if self.most else self.rows
                if out is None:
                    schema = table.schema.with_metadata({**(table.schema.metadata or {}), **{k.encode(): v.encode() for k, v in self.footer.items()}})
                    paths.append(f"{folder}/part-{self.job}-{task.partitionId():05d}-{task.taskAttemptId()}-{len(paths):03d}.parquet")
                    out = pq.ParquetWriter(paths[-1], schema, filesystem=system, compression=self.compression, write_page_index=True, sorting_columns=[pq.SortingColumn(table.schema.get_field_index("block"))])
                part, rest = table.slice(0, room), table.slice(room)
                out.write_table(part.cast(out.schema), row_group_size=self.rows)
                in_file += part.num_rows
                held = rest.to_batches() if rest.num_rows else []
                if in_file == self.most:
                    out.close()
                    out, in_file = None, 0

        for b in batches:
            if b.num_rows:
                held.append(b)
                flush(False)
        flush(True)
        if out is not None:
            out.close()
        return Written(tuple(paths))

    def _remove(self, keep: set[str]) -> None:
        system, folder = open_at(self.path)
        if system.get_file_info(folder).type != FileType.Directory:
            return
        for f in system.get_file_info(FileSelector(folder)):
            if f.base_name.startswith(f"part-{self.job}-") and f.path not in keep:
                system.delete_file(f.path)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files of tasks that were run twice go: only those that committed stay."""
        self._remove({p for m in messages if m for p in m.paths})

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._remove(set())


def read_tiff(data: bytes) -> tuple[np.ndarray, dict]:
    """Rows x columns x bands of a TIFF in memory, with its fields by tag."""
    order, found = _directories(lambda at, n: data[at : at + n])
    image = _tiff_image(found[0], lambda at, n: data[at : at + n], order)
    return image.window(0, image.height, 0, image.width).transpose(1, 2, 0), found[0]


def tiff_pixels(values: np.ndarray, fields: dict) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of the columns' and rows' centres of a TIFF, in its own reference system."""
    sx, sy = fields[33550][:2]
    c, r, _, x, y, _ = fields[33922][:6]
    return x + (np.arange(values.shape[1]) - c + 0.5) * sx, y - (np.arange(values.shape[0]) - r + 0.5) * sy


def register(spark) -> None:
    spark.dataSource.register(GridSource)
    spark.dataSource.register(TileSink)
