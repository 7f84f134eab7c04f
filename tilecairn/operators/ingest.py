"""Raster files to tiles: the geometry of a file on the tile grid, resampling onto it, and the table.

A target pixel gathers what it needs from the source, so at a finer zoom than the source's no pixel stays
empty. Each task reads only the blocks of the file under its tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tilecairn.functions.cells import cell_of, checked_block_size
from tilecairn.functions.mercator import CIRCLE, LEAST_OVERVIEW
from tilecairn.functions.pixels import TYPES, encode, nodata_value, valid
from tilecairn.functions.projections import box_to_degrees, from_degrees, is_separable, to_degrees
from tilecairn.operators.convert import Layout, Overviews, ZoomStrategy, build_table
from tilecairn.operators.pyramid import KERNELS, REDUCERS, _kernel
from tilecairn.sources.rasters import Image, grid_index, open_at, open_image

#: Values gathered at a time while a tile is resampled.
GATHERED = 1 << 22
#: A source overview serves a zoom if its reduction is within this share of the one wanted.
TOLERANCE = 0.1


@dataclass(frozen=True)
class Geometry:
    """A raster file on the tile grid: bounds in degrees and metres, resolution in metres, zooms, and its tiles."""

    bounds: tuple[float, float, float, float]
    metres: tuple[float, float, float, float]
    resolution: float
    zoom: int
    least_zoom: int
    size: int
    bands: int
    kind: str
    nodata: float | None

    def tiles(self, zoom: int) -> tuple[int, int, int, int]:
        """First and last column and row of the tiles at a zoom that the raster meets."""
        w, s, e, n = self.metres
        unit, edge, most = CIRCLE / (1 << zoom), CIRCLE / 2, (1 << zoom) - 1
        place = lambda v, up: max(0, min(most, math.ceil(v - 1e-9) - 1 if up else math.floor(v + 1e-9)))
        x0, y0 = place((w + edge) / unit, False), place((edge - n) / unit, False)
        return x0, max(x0, place((e + edge) / unit, True)), y0, max(y0, place((edge - s) / unit, True))

    def children(self, x: int, y: int, zoom: int) -> list[tuple[int, int]]:
        """The tiles one zoom down within a tile, of those that the raster meets."""
        x0, x1, y0, y1 = self.tiles(zoom + 1)
        return [(a, b) for b in (2 * y, 2 * y + 1) for a in (2 * x, 2 * x + 1) if x0 <= a <= x1 and y0 <= b <= y1]


def geometry(image: Image, strategy: ZoomStrategy = ZoomStrategy.AUTO, size: int = 256, zoom: int | None = None, least_zoom: int | None = None) -> Geometry:
    """Where a raster lies. The zoom is the nearest to its resolution, or the next finer (upper) or coarser (lower);
    the least one that at which its diagonal is near LEAST_OVERVIEW pixels. What lies beyond the square world goes."""
    checked_block_size(size)
    w, s, e, n = box_to_degrees(image.bounds, image.crs)
    (x0, x1), (y0, y1) = from_degrees(np.array([max(w, -180.0), min(e, 180.0)]), np.array([s, n]), "EPSG:3857")
    if x0 >= x1 or y0 >= y1:
        raise ValueError("the raster lies outside the square world")
    (left, right), (bottom, top) = from_degrees(np.array([w, e]), np.array([s, n]), "EPSG:3857")
    resolution = math.hypot(right - left, top - bottom) / math.hypot(image.width, image.height)
    block_zoom = int(math.log2(size))
    exact = math.log2(CIRCLE / size / resolution)
    z = {"upper": math.ceil, "lower": math.floor, "auto": round}[str(strategy)](exact) if zoom is None else zoom
    z = max(0, min(26 - block_zoom, z))
    if least_zoom is None:
        pixels = math.hypot(x1 - x0, y1 - y0) / (CIRCLE / size / (1 << z))
        least_zoom = max(0, z - max(0, round(math.log2(max(1.0, pixels / LEAST_OVERVIEW)))))
    nodata = nodata_value(image.nodata)
    lon, lat = to_degrees([x0, x1], [y0, y1], "EPSG:3857")
    return Geometry((float(lon[0]), float(lat[0]), float(lon[1]), float(lat[1])), (float(x0), float(y0), float(x1), float(y1)), resolution, z, min(z, least_zoom), size, image.bands, image.kind, nodata)


def matching_overview(image: Image, reduction: float) -> Image | None:
    """The overview of a Mercator file that stands for a reduction; None if none does or the file is in another system."""
    from tilecairn.functions.projections import MERCATOR, code_of

    if code_of(image.crs) not in MERCATOR:
        return None
    return next((o for o in image.overviews if abs(image.width / o.width - reduction) <= TOLERANCE * reduction), None)


def resampled(values: np.ndarray, y: np.ndarray, x: np.ndarray, sy: np.ndarray, sx: np.ndarray, how: str) -> np.ndarray:
    """Pixels of a source (rows x columns, NaN where there is none) at places y, x, in source pixels from its first
    corner; sy, sx: how many source pixels a target pixel spans. All four broadcast to rows x columns.

    Reducers take the pixels whose centre lies in the span, or the one under the place where there is none.
    Interpolating kernels widen by the span where that is over one, and weigh valid pixels only. A
    place outside the source, or on a pixel without a value for a kernel, is NaN.
    """
    h, w = np.broadcast(y, x).shape
    rows, columns = values.shape
    inside = (y >= 0) & (y < rows) & (x >= 0) & (x < columns)
    iy, ix = np.clip(np.floor(y).astype(int), 0, rows - 1), np.clip(np.floor(x).astype(int), 0, columns - 1)
    if how == "near":
        return np.where(inside, values[iy, ix], np.nan)
    if how in KERNELS:
        reach = [math.ceil(KERNELS[how] * max(1.0, float(s.max(initial=1.0)))) for s in (sy, sx)]
        offsets = [np.arange(-r, r + 1) for r in reach]
    else:
        first = [np.ceil(p - s / 2 - 0.5).astype(int) for p, s in ((y, sy), (x, sx))]
        many = [np.ceil(p + s / 2 - 0.5).astype(int) - f for p, s, f in zip((y, x), (sy, sx), first, strict=True)]
        first = [np.where(m > 0, f, i) for m, f, i in zip(many, first, (iy, ix), strict=True)]
        many = [np.maximum(m, 1) for m in many]
        offsets = [np.arange(int(m.max(initial=1))) for m in many]
    out = np.full((h, w), np.nan)
    step = max(1, GATHERED // max(1, w * len(offsets[0]) * len(offsets[1])))
    of = lambda v, at: v[at : at + step] if v.shape[0] == h else v
    for at in range(0, h, step):
        if how in KERNELS:
            places, weights = [], []
            for p, i, s, o, most in ((of(y, at), of(iy, at), of(sy, at), offsets[0], rows), (of(x, at), of(ix, at), of(sx, at), offsets[1], columns)):
                place = i[..., None] + o
                weights.append(_kernel(how, (place + 0.5 - p[..., None]) / np.maximum(1.0, s)[..., None]) * ((place >= 0) & (place < most)))
                places.append(np.clip(place, 0, most - 1))
            got = values[places[0][..., :, None], places[1][..., None, :]]
            good = ~np.isnan(got)
            weight = weights[0][..., :, None] * weights[1][..., None, :] * good
            total = weight.sum(axis=(-1, -2))
            with np.errstate(invalid="ignore", divide="ignore"):
                part = np.where(np.abs(total) > 1e-9, (weight * np.where(good, got, 0.0)).sum(axis=(-1, -2)) / total, np.nan)
            part = np.where(np.isnan(values[of(iy, at), of(ix, at)]), np.nan, part)
        else:
            place = [of(f, at)[..., None] + o for f, o in zip(first, offsets, strict=True)]
            kept = [(o < of(m, at)[..., None]) & (p >= 0) & (p < most) for o, m, p, most in zip(offsets, many, place, (rows, columns), strict=True)]
            got = values[np.clip(place[0], 0, rows - 1)[..., :, None], np.clip(place[1], 0, columns - 1)[..., None, :]]
            got = np.where(kept[0][..., :, None] & kept[1][..., None, :], got, np.nan)
            part = REDUCERS[how](got.reshape(*got.shape[:2], -1))
        out[at : at + step] = part
    return np.where(inside, out, np.nan)


def warped(image: Image, x: int, y: int, zoom: int, size: int, how: str) -> list[np.ndarray] | None:
    """The bands of a tile, size x size doubles with NaN where there is no value; None where the raster has none."""
    unit = CIRCLE / (1 << zoom) / size
    edge = CIRCLE / 2
    mx, my = x * size * unit - edge + np.arange(size + 1) * unit, edge - y * size * unit - np.arange(size + 1) * unit
    middle = lambda v: (v[1:] + v[:-1]) / 2
    if is_separable(image.crs):
        lon, _ = to_degrees(mx, np.zeros(size + 1), "EPSG:3857")
        _, lat = to_degrees(np.zeros(size + 1), my, "EPSG:3857")
        cx, _ = from_degrees(lon, np.zeros(size + 1), image.crs)
        _, cy = from_degrees(np.zeros(size + 1), lat, image.crs)
        ex, ey = (cx - image.origin[0]) / image.step[0], (cy - image.origin[1]) / image.step[1]
        fx, fy, sx, sy = middle(ex)[None, :], middle(ey)[:, None], np.abs(np.diff(ex))[None, :], np.abs(np.diff(ey))[:, None]
    else:
        lon, lat = to_degrees(*np.meshgrid(mx, my), "EPSG:3857")
        cx, cy = from_degrees(lon, lat, image.crs)
        ex, ey = (cx - image.origin[0]) / image.step[0], (cy - image.origin[1]) / image.step[1]
        corners = lambda v: (v[1:, 1:] + v[1:, :-1] + v[:-1, 1:] + v[:-1, :-1]) / 4
        span = lambda v: np.maximum(np.abs(v[1:, 1:] - v[:-1, :-1]), np.abs(v[1:, :-1] - v[:-1, 1:]))
        fx, fy, sx, sy = corners(ex), corners(ey), span(ex), span(ey)
    reach = KERNELS.get(how, 1) + 1
    pad = [int(math.ceil(reach * max(1.0, float(s.max())))) for s in (sy, sx)]
    top, bottom = max(0, int(np.floor(fy.min())) - pad[0]), min(image.height, int(np.ceil(fy.max())) + pad[0] + 1)
    left, right = max(0, int(np.floor(fx.min())) - pad[1]), min(image.width, int(np.ceil(fx.max())) + pad[1] + 1)
    if top >= bottom or left >= right:
        return None
    nodata, out = nodata_value(image.nodata), []
    for band in image.window(top, bottom, left, right):
        values = np.where(valid(band, nodata), band.astype("f8"), np.nan)
        out.append(resampled(values, fy - top, fx - left, sy, sx, how))
    return out if any(not np.isnan(b).all() for b in out) else None


def typed(values: np.ndarray, kind: str, nodata) -> np.ndarray:
    """Doubles as pixels: NaN is nodata (without one NaN or 0), integers are rounded half to even within their range."""
    blank = nodata if nodata is not None else np.nan if kind[0] == "f" else 0
    if kind[0] == "f":
        return np.where(np.isnan(values), blank, values).astype(TYPES[kind])
    limits = np.iinfo(TYPES[kind])
    return np.where(np.isnan(values), blank, np.clip(np.rint(values), limits.min, limits.max)).astype(TYPES[kind])


@dataclass
class Strip(InputPartition):
    """Tiles of a row of tiles: columns first to last."""

    y: int
    first: int
    last: int


class RasterSource(DataSource):
    """format("raster_file"): tiles (block, band_1, ...) of a TIFF or ASCII grid on any file system that Arrow knows.

    Options: zoom_strategy (auto), zoom, block_size (256), resampling (near), compression (gzip), tiles_per_partition
    (64), assume_lonlat (true). A partition is a run of tiles in one row; its task reads the blocks under them.
    """

    @classmethod
    def name(cls) -> str:
        return "raster_file"

    def _planned(self) -> tuple[Image, Geometry]:
        o = self.options
        image = open_image(o["path"], o.get("assume_lonlat", "true").lower() == "true")
        return image, geometry(image, o.get("zoom_strategy", "auto"), int(o.get("block_size", 256)), int(o["zoom"]) if o.get("zoom") else None)

    def schema(self) -> str:
        image, _ = self._planned()
        return ", ".join(["block long", *(f"band_{i + 1} binary" for i in range(image.bands))])

    def reader(self, schema) -> DataSourceReader:
        return RasterReader(dict(self.options))


class RasterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.path, self.assume = options["path"], options.get("assume_lonlat", "true").lower() == "true"
        self.how, self.compression = options.get("resampling", "near"), options.get("compression", "gzip")
        if self.how not in REDUCERS and self.how not in KERNELS:
            raise ValueError(f"unknown resampling {self.how}")
        system, where = open_at(self.path)
        with system.open_input_file(where) as f:
            self.index = None if f.read(2) in (b"II", b"MM") else (f.seek(0), grid_index(f))[1]
        self.geometry = geometry(self._image(), options.get("zoom_strategy", "auto"), int(options.get("block_size", 256)), int(options["zoom"]) if options.get("zoom") else None)

    def _image(self) -> Image:
        return open_image(self.path, self.assume, self.index)

    def partitions(self) -> list[InputPartition]:
        x0, x1, y0, y1 = self.geometry.tiles(self.geometry.zoom)
        step = int(self.options.get("tiles_per_partition", 64))
        return [Strip(y, x, min(x1, x + step - 1)) for y in range(y0, y1 + 1) for x in range(x0, x1 + 1, step)]

    def read(self, partition: Strip) -> Iterator[pa.RecordBatch]:
        g, image = self.geometry, self._image()
        # an overview of the file serves a zoom that is as much coarser than the file
        reduction = CIRCLE / (1 << g.zoom) / g.size / g.resolution
        source = (matching_overview(image, reduction) if self.options.get("source_overviews", "true").lower() == "true" else None) or image
        for x in range(partition.first, partition.last + 1):
            bands = warped(source, x, partition.y, g.zoom, g.size, self.how)
            if bands is not None:
                blobs = [pa.array([encode(typed(b, g.kind, g.nodata), g.kind, self.compression)], pa.binary()) for b in bands]
                yield pa.RecordBatch.from_arrays([pa.array([cell_of(x, partition.y, g.zoom)], pa.int64()), *blobs], ["block", *(f"band_{i + 1}" for i in range(len(blobs)))])


def raster_tiles(spark: SparkSession, path: str, **options) -> DataFrame:
    """The tiles of a raster file at one zoom; options as RasterSource has them. Tiles without a value are left out."""
    spark.dataSource.register(RasterSource)
    return spark.read.format("raster_file").options(**{k: str(v) for k, v in options.items() if v is not None}).load(path)


def convert_raster(spark: SparkSession, path: str, table: str, zoom_strategy: ZoomStrategy = ZoomStrategy.AUTO, resampling: str = "near", block_size: int = 256, zoom: int | None = None, least_zoom: int | None = None, overviews: Overviews = Overviews.AUTO, layout: Layout = Layout.SEQUENTIAL, compression: str | None = "gzip", quality: int = 85, tile_statistics: bool = False, group_rows: int = 200, file_bytes: int = 0, assume_lonlat: bool = True, **more) -> dict:
    """Write a raster file as a table with overviews and metadata; gives the metadata.

    Overviews average the four tiles below, but where a Mercator file has an overview of its own for a zoom,
    that zoom is made from it.
    """
    image = open_image(path, assume_lonlat)
    g = geometry(image, zoom_strategy, block_size, zoom, least_zoom)
    common = {"block_size": block_size, "resampling": resampling, "assume_lonlat": assume_lonlat}
    native = raster_tiles(spark, path, zoom=g.zoom, **common)
    own = {}
    if overviews == Overviews.AUTO:
        for z in range(g.zoom - 1, g.least_zoom - 1, -1):
            if matching_overview(image, CIRCLE / (1 << z) / block_size / g.resolution) is not None:
                own[z] = raster_tiles(spark, path, zoom=z, **common)
    entries = {}
    for i in range(image.bands):
        item = image.items[i] if i < len(image.items) else {}
        number = lambda k, item=item: float(item[k]) if k in item else None
        entries[f"band_{i + 1}"] = {"description": item.get("description"), "unit": item.get("unittype"), "scale": number("scale"), "offset": number("offset"), "colorinterp": image.colours[i] if i < len(image.colours) else None, "colortable": image.palette if i == 0 else None}
    return build_table(spark, native, table, image.kind, g.zoom, block_size, g.least_zoom, overviews, "average", layout, compression, tile_statistics, g.nodata, group_rows, file_bytes, bands=entries, own=own, quality=quality, **more)


