"""Tiles as pictures and raster files."""

from __future__ import annotations

import io
import math
import shutil
import struct
import tempfile
import zlib
from collections.abc import Iterator
from functools import partial
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilecairn.functions.cells import cell_x, cell_y
from tilecairn.functions.mercator import CIRCLE
from tilecairn.functions.pixels import TYPES, band_of_udf, decode, decode_udf, display, nodata_value
from tilecairn.plans.ranges import in_zoom
from tilecairn.sources.rasters import COLOURS, info, open_at
from tilecairn.sources.tables import read_metadata, read_table

def mosaic(tiles: DataFrame, band: str, kind: str, size: int, zoom: int, nodata=None, compression: str | None = None) -> DataFrame:
    """Rows column, row, value: the valid pixels of a zoom by their place from the table's top left corner."""
    level = tiles.where(in_zoom(F.col("block"), zoom)).select(cell_x(F.col("block")).alias("_x"), cell_y(F.col("block")).alias("_y"), F.col(band).alias("_b"))
    corner = level.agg(F.min("_x").alias("_x0"), F.min("_y").alias("_y0"))  # one row
    placed = level.join(F.broadcast(corner)).select((F.col("_x") - F.col("_x0")).alias("_c"), (F.col("_y") - F.col("_y0")).alias("_r"), decode_udf(kind, compression, nodata=nodata)("_b").alias("_v"))
    out = placed.select("_c", "_r", F.posexplode("_v").alias("_i", "value")).where("value is not null")
    return out.select((F.col("_c") * size + F.col("_i") % size).alias("column"), (F.col("_r") * size + F.floor(F.col("_i") / size)).alias("row"), "value")


def overview_factors(least: int, most: int, width: int, height: int, size: int) -> list[int]:
    """Factors of the overviews that a raster file gets: those of which a side is still a block."""
    return [2 ** (most - z) for z in range(most - 1, least - 1, -1) if min(width, height) // 2 ** (most - z) >= size]


def png(bands: list[np.ndarray], size: int) -> bytes:
    """A PNG of one (grey) or three (RGB) bands of bytes."""
    data = np.stack([b.reshape(size, size) for b in bands], axis=-1).astype(np.uint8)
    raw = b"".join(b"\0" + row.tobytes() for row in data)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", size, size, 8, 0 if len(bands) == 1 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def render_udf(kind: str, size: int, compression: str | None = None):
    """A function of up to three blobs that gives a PNG: three bands as RGB, one as grey, two filled up with the
    first; a null blob is black."""

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda blobs: _render(list(blobs), kind, size, compression))

    return run


def _render(blobs: list, kind: str, size: int, compression: str | None) -> bytes:
    bands = [np.zeros(size * size, np.uint8) if b is None else display(decode(b, kind, compression)) for b in blobs[:3]]
    return png(bands if len(bands) in (1, 3) else [*bands, bands[0]], size)


def tiff(values: np.ndarray, left: float, top: float, pixel: float, block: int, nodata=None, colours: dict | None = None) -> bytes:
    """A tiled, deflated TIFF of an array of rows and columns (of bands, where it has three axes) with the place of
    its top left corner in Mercator metres. For arrays in memory; tables are written by export_tiff()."""
    if values.ndim == 2:
        values = values[..., None]
    h, w, bands = values.shape
    out = io.BytesIO()
    writer = TiffWriter(out, bands, values.dtype.name, block, nodata, colours, big=False)
    blocks = {}
    for i, (y, x) in enumerate((y, x) for y in range(0, h, block) for x in range(0, w, block)):
        part = np.zeros((block, block, bands), values.dtype)
        cut_ = values[y : y + block, x : x + block]
        part[: cut_.shape[0], : cut_.shape[1]] = cut_
        blocks[i] = writer.put(deflated(part))
    writer.level(w, h, blocks, left, top, pixel)
    writer.finish()
    return out.getvalue()


def deflated(part: np.ndarray) -> bytes:
    """A block as a TIFF file holds it."""
    return zlib.compress(np.ascontiguousarray(part.astype(part.dtype.newbyteorder("<"))).tobytes())


class TiffWriter:
    """Writes a tiled TIFF in one pass: blocks as they come, then the directories of the levels, the full one first.

    A big file has 64-bit places. Blocks that nobody wrote are left out (no bytes), which readers take as nodata.
    """

    def __init__(self, file, bands: int, kind: str, block: int, nodata=None, palette: dict | None = None, colours: list[str] | None = None, big: bool = True, descriptions: list | None = None):
        self.file, self.bands, self.kind, self.block, self.nodata, self.palette, self.big = file, bands, kind, block, nodata, palette, big
        self.colours, self.descriptions = colours or [], descriptions or []
        if unknown := [c for c in self.colours if c and c.lower() not in COLOURS]:
            raise ValueError(f"unknown color interpretation {unknown[0]}")
        self.levels: list[tuple] = []
        file.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0) if big else struct.pack("<2sHI", b"II", 42, 0))

    def put(self, data: bytes) -> tuple[int, int]:
        """Write a block; gives its place and size."""
        at = self.file.tell()
        self.file.write(data)
        return at, len(data)

    def level(self, width: int, height: int, blocks: dict[int, tuple[int, int]], left: float, top: float, pixel: float) -> None:
        self.levels.append((width, height, blocks, left, top, pixel))

    def _items(self) -> bytes:
        rows = [f'<Item name="COLORINTERP" sample="{i}" role="colorinterp">{c.capitalize()}</Item>' for i, c in enumerate(self.colours) if c]
        rows += [f'<Item name="DESCRIPTION" sample="{i}" role="description">{escape(d)}</Item>' for i, d in enumerate(self.descriptions) if d]
        return f"<GDALMetadata>{''.join(rows)}</GDALMetadata>".encode() + b"\0" if rows else b""

    def _fields(self, k: int) -> list[tuple[int, str, list | bytes]]:
        width, height, blocks, left, top, pixel = self.levels[k]
        bits, form = np.dtype(self.kind).itemsize * 8, {"u": 1, "i": 2, "f": 3}[np.dtype(self.kind).kind]
        n = -(-width // self.block) * -(-height // self.block)
        places = [blocks.get(i, (0, 0)) for i in range(n)]
        word = "Q" if self.big else "I"
        rgb = self.bands >= 3 and (bits == 8 or [c.lower() for c in self.colours[:3]] == ["red", "green", "blue"])
        extra = self.bands - (3 if rgb else 1)
        alpha = lambda i: i < len(self.colours) and (self.colours[i] or "").lower() == "alpha"
        fields: list[tuple[int, str, list | bytes]] = [
            (254, "I", [1 if k else 0]), (256, "I", [width]), (257, "I", [height]), (258, "H", [bits] * self.bands), (259, "H", [8]), (262, "H", [3 if self.palette else 2 if rgb else 1]), (277, "H", [self.bands]), (284, "H", [1]),
            (322, "I", [self.block]), (323, "I", [self.block]), (324, word, [p for p, _ in places]), (325, word, [c for _, c in places]), (339, "H", [form] * self.bands),
            (33550, "d", [pixel, pixel, 0.0]), (33922, "d", [0.0, 0.0, 0.0, left, top, 0.0]), (34735, "H", [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, 3857]),
        ]
        if extra > 0:
            fields.append((338, "H", [2 if alpha(self.bands - extra + i) else 0 for i in range(extra)]))
        if self.palette and bits <= 16:
            table = np.zeros((1 << bits, 3), np.int64)
            for key, v in self.palette.items():
                table[int(key)] = [c * 257 for c in v[:3]]
            fields.append((320, "H", table.T.ravel().tolist()))
        if k == 0 and (text := self._items()):
            fields.append((42112, "s", text))
        if self.nodata is not None:
            fields.append((42113, "s", f"{self.nodata}".encode() + b"\0"))
        return sorted(fields, key=lambda f: f[0])

    def finish(self) -> None:
        """Write the directories and the place of the first one."""
        codes = {"s": 2, "H": 3, "I": 4, "d": 12, "Q": 16}
        word, inline, link = ("Q", 8, 8) if self.big else ("I", 4, 4)
        for k in range(len(self.levels)):
            entries = []
            for tag, code, value in self._fields(k):
                body = value if isinstance(value, bytes) else struct.pack(f"<{len(value)}{code}", *value)
                if len(body) > inline:
                    self.file.write(b"\0" * (-self.file.tell() % 8))
                    at = self.file.tell()
                    self.file.write(body)
                    held = struct.pack("<" + word, at)
                else:
                    held = body.ljust(inline, b"\0")
                entries.append(struct.pack("<HH" + word, tag, codes[code], len(value)) + held)
            self.file.write(b"\0" * (-self.file.tell() % 8))
            at = self.file.tell()
            self.file.seek(link)
            self.file.write(struct.pack("<" + word, at))
            self.file.seek(at)
            self.file.write(struct.pack("<Q" if self.big else "<H", len(entries)) + b"".join(entries))
            link = self.file.tell()
            self.file.write(struct.pack("<" + word, 0))


def _blocks(batches, bands: list[str], kind: str, size: int, nodata, compression: str | None):
    """Rows z, i, data: blocks of a TIFF file, all bands together, from the pieces of tiles in each."""
    blank = nodata_value(nodata) if nodata is not None else 0
    for batch in batches:
        out = []
        for pieces in batch.column("pieces"):
            block = np.full((size, size, len(bands)), blank, TYPES[kind])
            for p in pieces.as_py():
                x, y = p["x"], p["y"]
                for k, b in enumerate(bands):
                    if p[b] is not None:
                        part = decode(p[b], kind, compression).reshape(size, size)[max(0, -y) : size - max(0, y), max(0, -x) : size - max(0, x)]
                        block[max(0, y) : max(0, y) + part.shape[0], max(0, x) : max(0, x) + part.shape[1], k] = part
            out.append(deflated(block))
        yield pa.RecordBatch.from_arrays([batch.column("z"), batch.column("i"), pa.array(out, pa.binary())], ["z", "i", "data"])


def export_tiff(tiles: DataFrame, bands: list[str], kind: str, size: int, zoom: int, path: str, nodata=None, colours: dict | None = None, least_zoom: int | None = None, interpretations: list[str] | None = None, descriptions: list | None = None, compression: str | None = None, most_pixels: int | None = None) -> tuple[int, int]:
    """Write the tiles of a zoom as one tiled TIFF file, with the overviews down to least_zoom that overview_factors()
    gives; gives width and height.

    A tile is a block of the file, or of an overview, which begins where the full raster does, in parts of up to four:
    executors decode and deflate, and the driver appends the blocks as they come, a partition at a time, so no raster has to fit it. Files that may pass 2 GB have 64-bit places. A caller may
    set most_pixels, beyond which this raises.
    """
    x, y = cell_x(F.col("block")), cell_y(F.col("block"))
    r = tiles.where(in_zoom(F.col("block"), zoom)).agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    if r[0] is None:
        raise ValueError(f"no tiles at zoom {zoom}")
    w, h = (r[1] - r[0] + 1) * size, (r[3] - r[2] + 1) * size
    if most_pixels is not None and w * h * len(bands) > most_pixels:
        raise ValueError(f"{w} x {h} pixels are more than {most_pixels}")
    factors = overview_factors(zoom if least_zoom is None else least_zoom, zoom, w, h, size)
    zooms = [zoom] + [zoom - int(math.log2(f)) for f in factors if f <= size]
    start = {z: (r[0] * size >> zoom - z, r[2] * size >> zoom - z) for z in zooms}  # the corner in pixels of each zoom
    across = {z: -(-(w >> zoom - z) // size) for z in zooms}
    packed = partial(_blocks, bands=bands, kind=kind, size=size, nodata=nodata, compression=compression)
    blocks = None
    for z in zooms:
        at_x, at_y = x * size - start[z][0], y * size - start[z][1]
        level = tiles.where(in_zoom(F.col("block"), z)).select(at_x.alias("_x"), at_y.alias("_y"), *bands)
        column, row = F.floor(F.col("_x") / size), F.floor(F.col("_y") / size)
        steps = [[0] if v % size == 0 else [0, 1] for v in start[z]]
        # where the corner is no corner of a tile, a tile is spread over up to four blocks, of which each gets its part
        parts = F.array(*(F.struct((column + i).alias("c"), (row + j).alias("r")) for j in steps[1] for i in steps[0]))
        placed = level.select("*", F.explode(parts).alias("_p")).where((F.col("_p.c") >= 0) & (F.col("_p.r") >= 0) & (F.col("_p.c") < across[z]))
        piece = F.struct((F.col("_x") - F.col("_p.c") * size).cast("int").alias("x"), (F.col("_y") - F.col("_p.r") * size).cast("int").alias("y"), *bands)
        if max(map(len, steps)) == 1:
            gathered = placed.select("_p.c", "_p.r", F.array(piece).alias("pieces"))
        else:
            gathered = placed.groupBy(F.col("_p.c").alias("c"), F.col("_p.r").alias("r")).agg(F.collect_list(piece).alias("pieces"))
        out = gathered.select(F.lit(z).alias("z"), (F.col("r") * across[z] + F.col("c")).cast("long").alias("i"), "pieces").mapInArrow(packed, "z int, i long, data binary")
        blocks = out if blocks is None else blocks.unionByName(out)
    found: dict[int, dict[int, tuple[int, int]]] = {z: {} for z in zooms}
    system, where = open_at(path)
    big = w * h * len(bands) * np.dtype(kind).itemsize > 1 << 31
    with tempfile.TemporaryFile() as f:  # directories refer back, so the file is put together here and copied
        writer = TiffWriter(f, len(bands), kind, size, nodata, colours, interpretations, big, descriptions)
        for row in blocks.toLocalIterator():
            found[row["z"]][row["i"]] = writer.put(row["data"])
        unit = CIRCLE / (1 << zoom)
        left, top = r[0] * unit - CIRCLE / 2, CIRCLE / 2 - r[2] * unit
        for z in zooms:
            scale = 1 << zoom - z
            writer.level(w // scale, h // scale, found[z], left, top, unit / size * scale)
        writer.finish()
        f.seek(0)
        with system.open_output_stream(where) as out:
            shutil.copyfileobj(f, out, 1 << 22)
    return w, h


def export_table(spark: SparkSession, table: str, path: str, overviews: bool = True) -> dict:
    """Write a table as a TIFF file by what its metadata tell; gives info() of the file."""
    meta = read_metadata(spark, table)
    t, entries = meta["tiling"], meta["bands"]
    tiles, names, compression = read_table(spark, table), [b["name"] for b in entries], meta.get("compression")
    kind = entries[0]["type"]
    if meta.get("band_layout") == "interleaved":
        tiles = tiles.select("block", *(band_of_udf(kind, len(names), i + 1, compression)("pixels").alias(n) for i, n in enumerate(names)))
        compression = None
    nodata = entries[0].get("nodata")
    export_tiff(tiles, names, kind, t["block_width"], t["max_zoom"], path, nodata, entries[0].get("colortable"), t["min_zoom"] if overviews else None, [b.get("colorinterp") for b in entries], [b.get("description") for b in entries], compression)
    return info(path)
