"""Overviews and resampling."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilecairn.functions.cells import cell_x, cell_y, left, parent, resolution
from tilecairn.functions.pixels import TYPES, decode, encode, valid
from tilecairn.plans.scratch import cut


def _quantile(q: float) -> Callable:
    def run(v: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return _with_values(v, lambda x: np.nanquantile(x, q, axis=-1))

    return run


def _with_values(v: np.ndarray, f: Callable) -> np.ndarray:
    """f over rows that have a value; NaN for the others."""
    some = ~np.isnan(v).all(axis=-1)
    out = np.full(v.shape[:-1], np.nan)
    if some.any():
        out[some] = f(v[some])
    return out


def _mode(v: np.ndarray) -> np.ndarray:
    """The most frequent value; of several the least."""
    s = np.sort(v, axis=-1)
    n = np.array([(s == s[..., i : i + 1]).sum(axis=-1) for i in range(s.shape[-1])])
    return np.take_along_axis(s, n.argmax(axis=0)[..., None], axis=-1)[..., 0]


#: Ways to make one pixel of the valid ones of a square (NaN marks the others); near takes the top left.
REDUCERS: dict[str, Callable] = {
    "average": lambda v: _with_values(v, lambda x: np.nanmean(x, axis=-1)),
    "min": lambda v: _with_values(v, lambda x: np.nanmin(x, axis=-1)),
    "max": lambda v: _with_values(v, lambda x: np.nanmax(x, axis=-1)),
    "sum": lambda v: _with_values(v, lambda x: np.nansum(x, axis=-1)),
    "rms": lambda v: _with_values(v, lambda x: np.sqrt(np.nanmean(x * x, axis=-1))),
    "med": _quantile(0.5),
    "q1": _quantile(0.25),
    "q3": _quantile(0.75),
    "mode": _mode,
    "near": lambda v: v[..., 0],
}


def _kernel(name: str, t: np.ndarray) -> np.ndarray:
    """Weights of the interpolating kernels at a distance in pixels."""
    a = np.abs(t)
    if name == "bilinear":
        return np.maximum(0.0, 1 - a)
    if name == "cubic":
        return np.where(a <= 1, 1.5 * a**3 - 2.5 * a**2 + 1, np.where(a < 2, -0.5 * a**3 + 2.5 * a**2 - 4 * a + 2, 0.0))
    if name == "cubicspline":
        return np.where(a <= 1, 2 / 3 - a**2 + a**3 / 2, np.where(a < 2, (2 - a) ** 3 / 6, 0.0))
    return np.where(a < 3, np.sinc(t) * np.sinc(t / 3), 0.0)


#: Support in pixels of the interpolating kernels.
KERNELS = {"bilinear": 1, "cubic": 2, "cubicspline": 2, "lanczos": 3}


def halved(values: np.ndarray, how: str) -> np.ndarray:
    """A square of even size at half the size; NaN marks pixels that do not count. Interpolating kernels, twice
    as wide as they reach, weigh the valid pixels within the square."""
    n = len(values)
    if how in REDUCERS:
        return REDUCERS[how](values.reshape(n // 2, 2, n // 2, 2).swapaxes(1, 2).reshape(n // 2, n // 2, 4))
    at = (np.arange(n // 2) + 0.5) * 2 - 0.5
    w = _kernel(how, (np.arange(n)[None, :] - at[:, None]) / 2)
    good = ~np.isnan(values)
    total = w @ good.astype(float) @ w.T
    out = w @ np.where(good, values, 0.0) @ w.T
    return np.where(np.abs(total) > 1e-9, out / np.where(total == 0, 1, total), np.nan)


def _blank(kind: str, nodata) -> float:
    return nodata if nodata is not None else np.nan if kind[0] == "f" else 0


def overview(tiles: DataFrame, bands: list[str], kind: str, size: int, zoom: int, how: str = "average", nodata=None, compression: str | None = "gzip") -> DataFrame:
    """The tiles of ``zoom`` from those of the zoom below it, four pixels to one, ignoring nodata.

    Each tile is halved where it is, so that a quarter of its pixels travels, in the band's type, with a bit for
    each that has a value, and deflated; a parent then gathers its four quarters, which are few whatever the
    table holds. Other columns than bands and time are left out.
    """
    by = ["block", "time_cf"] if "time_cf" in tiles.columns else ["block"]
    names = [f"_{i}" for i in range(len(bands))]

    @F.pandas_udf("binary")
    def half(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda b: None if b is None else _quarter(b, kind, size, how, nodata))

    place = (cell_y(F.col("block")) % 2 * 2 + cell_x(F.col("block")) % 2).cast("int")
    quarters = tiles.select(parent(F.col("block"), zoom).alias("block"), *by[1:], place.alias("_place"), *(half(b).alias(n) for b, n in zip(bands, names, strict=True)))
    gathered = quarters.groupBy(*by).agg(*(F.collect_list(F.struct("_place", F.col(n).alias("v"))).alias(n) for n in names))

    @F.pandas_udf("binary")
    def join(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda quarters: _joined(quarters, kind, size, nodata, compression))

    return gathered.select(*by, *(join(n).alias(b) for b, n in zip(bands, names, strict=True)))


def _sent(values: np.ndarray, kind: str) -> bytes:
    """Doubles, NaN without a value, as deflated bits of those that have one and their pixels."""
    good = ~np.isnan(values)
    pixels = values[good] if kind[0] == "f" else np.rint(values[good])
    return zlib.compress(np.packbits(good).tobytes() + pixels.astype(TYPES[kind]).tobytes(), 1)


def _received(data: bytes, kind: str, n: int) -> np.ndarray:
    raw = zlib.decompress(data)
    good = np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8)), count=n).astype(bool)
    out = np.full(n, np.nan)
    out[good] = np.frombuffer(raw, TYPES[kind], offset=-(-n // 8))
    return out


def _quarter(blob: bytes, kind: str, size: int, how: str, nodata) -> bytes:
    raw = decode(blob, kind)
    values = np.where(valid(raw, nodata), raw.astype("f8"), np.nan).reshape(size, size)
    return _sent(halved(values, how).ravel(), kind)


def _joined(quarters, kind: str, size: int, nodata, compression: str | None) -> bytes | None:
    out = np.full((size, size), np.nan)
    h = size // 2
    for q in quarters:
        if q["v"] is not None:
            y, x = divmod(int(q["_place"]), 2)
            out[y * h : y * h + h, x * h : x * h + h] = _received(q["v"], kind, h * h).reshape(h, h)
    if np.isnan(out).all():
        return None
    return encode(np.where(np.isnan(out), _blank(kind, nodata), out), kind, compression)


def pyramid(tiles: DataFrame, bands: list[str], kind: str, size: int, most_zoom: int, least_zoom: int, how: str = "average", nodata=None, compression: str | None = "gzip", own: dict[int, DataFrame] | None = None) -> DataFrame:
    """The tiles of most_zoom and all overviews down to least_zoom, level from level.

    Each level is written once (under the shared folder) and read for the next one and for the result, so none
    is made twice and a lost executor costs one level's tasks. ``own`` holds levels that come from elsewhere,
    such as overviews of the source.
    """
    kept = ["block", *(["time_cf"] if "time_cf" in tiles.columns else []), *bands]
    out = level = cut(tiles.select(*kept)) if most_zoom > least_zoom else tiles.select(*kept)
    for z in range(most_zoom - 1, least_zoom - 1, -1):
        level = cut((own or {})[z].select(*kept) if z in (own or {}) else overview(level, bands, kind, size, z, how, nodata, compression))
        out = out.unionByName(level)
    return out


def pyramid_counts(tiles: DataFrame, least_zoom: int) -> DataFrame:
    """Rows zoom, tiles: how many tiles each zoom has when every tile has all its ancestors."""
    up = tiles.select(F.explode(F.transform(F.sequence(F.lit(least_zoom), resolution(F.col("block"))), lambda z: F.struct(z.alias("zoom"), parent(F.col("block"), z).alias("block")))).alias("a"))
    return up.select("a.*").distinct().groupBy("zoom").agg(F.count("*").alias("tiles"))


def hillslope(tiles: DataFrame, band: str, kind: str, size: int, pixel_metres: float, nodata=None, compression: str | None = "gzip") -> DataFrame:
    """block and slope (float32 degrees) of a terrain of one zoom, by Horn's method. A tile gets the rows and columns
    of pixels along its borders from its eight neighbours; where there is none, as beyond the square world, the
    border repeats."""
    z = resolution(F.col("block"))
    from tilecairn.functions.cells import tile_to_cell

    moves = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]

    @F.pandas_udf("array<binary>")
    def edges(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda b: [None] * 9 if b is None else _edges(b, kind, size, nodata))

    read = tiles.select("block", F.col(band).alias("_own"), edges(band).alias("_e"))
    sent = read.select("block", cell_x(F.col("block")).alias("_x"), cell_y(F.col("block")).alias("_y"), z.alias("_z"), "_own", "_e")
    offer = lambda i, dx, dy: F.struct(F.lit(i).alias("i"), (F.col("_x") + dx).alias("x"), (F.col("_y") + dy).alias("y"), (F.col("_own") if i == 4 else F.get("_e", F.lit(i))).alias("v"))
    offers = F.array(*(offer(i, dx, dy) for i, (dx, dy) in enumerate(moves)))
    given = sent.select("_z", F.explode(offers).alias("o")).where((F.least("o.x", "o.y") >= 0) & (F.greatest("o.x", "o.y") < left(1, F.col("_z"))) & F.col("o.v").isNotNull()).select(tile_to_cell(F.col("o.x"), F.col("o.y"), F.col("_z")).alias("block"), "o.i", "o.v")

    @F.pandas_udf("binary")
    def slope(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda given: _slope(given, kind, size, pixel_metres, nodata, compression))

    return given.groupBy("block").agg(F.collect_list(F.struct("i", "v")).alias("_g")).where(F.exists("_g", lambda g: g["i"] == 4)).select("block", slope("_g").alias("slope"))


def _doubles(blob: bytes, kind: str, size: int, nodata) -> np.ndarray:
    raw = decode(blob, kind)
    return np.where(valid(raw, nodata), raw.astype("f8"), np.nan).reshape(size, size)


def _edges(blob: bytes, kind: str, size: int, nodata) -> list[bytes | None]:
    """What a tile sends to the tile dx, dy away: a border or a corner. Itself it sends as it is stored."""
    v = _doubles(blob, kind, size, nodata)
    pick = {-1: slice(0, 1), 0: slice(None), 1: slice(size - 1, size)}
    return [_sent(v[pick[dy], pick[dx]].ravel(), kind) if dx or dy else None for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def _slope(given, kind: str, size: int, metres: float, nodata, compression: str | None) -> bytes:
    parts = {int(g["i"]): _doubles(g["v"], kind, size, nodata) if g["i"] == 4 else _received(g["v"], kind, 1 if g["i"] in (0, 2, 6, 8) else size) for g in given}
    wide = np.pad(parts[4], 1, mode="edge")
    place = {-1: slice(size + 1, size + 2), 0: slice(1, size + 1), 1: slice(0, 1)}  # what comes from dx = -1 is the right border
    for i, v in parts.items():
        if i != 4:
            dy, dx = i // 3 - 1, i % 3 - 1
            shape = (size if dy == 0 else 1, size if dx == 0 else 1)
            wide[place[dy], place[dx]] = v.reshape(shape)
    for i in (0, 2, 6, 8):  # a corner without a neighbour repeats that of a side
        if i not in parts:
            y, x = (size + 1 if i < 3 else 0), (size + 1 if i % 3 == 0 else 0)
            near_y, near_x = min(max(y, 1), size), min(max(x, 1), size)
            side = 3 if i % 3 == 0 else 5
            wide[y, x] = wide[near_y, x] if side in parts else wide[y, near_x]
    a, b, c = wide[:-2, :-2], wide[:-2, 1:-1], wide[:-2, 2:]
    d, f = wide[1:-1, :-2], wide[1:-1, 2:]
    g, h, i = wide[2:, :-2], wide[2:, 1:-1], wide[2:, 2:]
    dx = ((c + 2 * f + i) - (a + 2 * d + g)) / (8 * metres)
    dy = ((g + 2 * h + i) - (a + 2 * b + c)) / (8 * metres)
    return encode(np.degrees(np.arctan(np.hypot(dx, dy))), "float32", compression)

