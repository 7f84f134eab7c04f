"""Pixel blobs: encoding, decoding, layouts, band math; numpy within Arrow batches."""

from __future__ import annotations

import gzip
import io
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pixel types of tables.
TYPES = {"uint8": "<u1", "int8": "<i1", "uint16": "<u2", "int16": "<i2", "uint32": "<u4", "int32": "<i4", "uint64": "<u8", "int64": "<i8", "float16": "<f2", "float32": "<f4", "float64": "<f8"}
#: Pixel types of image services.
SERVICE_TYPES = {"U1": "uint8", "U2": "uint8", "U4": "uint8", "U8": "uint8", "S8": "int8", "U16": "uint16", "S16": "int16", "U32": "uint32", "S32": "int32", "F32": "float32", "F64": "float64"}
LOSSY = {"jpeg": (1, 3), "webp": (1, 3, 4)}
SPECIAL = {"NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def nodata_value(nodata) -> float | None:
    """nodata as a number; the names of special floats are understood."""
    return SPECIAL.get(nodata, nodata) if isinstance(nodata, str) else nodata


def squeeze(raw: bytes, compression: str | None) -> bytes:
    """Bytes as a blob: gzip (without a time, so that it is deterministic) or as they are."""
    if compression in (None, "none"):
        return raw
    if compression == "gzip":
        return gzip.compress(raw, 6, mtime=0)
    raise ValueError(f"{compression} is a lossy codec that needs an image library" if compression in LOSSY else f"unknown compression {compression}")


def stretch(blob: bytes, compression: str | None = None) -> bytes:
    """The bytes of a blob; without a compression given, gzip is recognised."""
    if compression == "gzip" or compression is None and blob[:2] == b"\x1f\x8b":
        return zlib.decompress(blob, 31)
    if compression in (None, "none"):
        return blob
    raise ValueError(f"{compression} blobs need an image library")


def encode(values: np.ndarray, kind: str, compression: str | None = "gzip") -> bytes:
    return squeeze(np.ascontiguousarray(values).astype(TYPES[kind]).tobytes(), compression)


def decode(blob: bytes, kind: str, compression: str | None = None) -> np.ndarray:
    return np.frombuffer(stretch(blob, compression), TYPES[kind])


def _pictures():
    """The image library, where there is one."""
    try:
        from PIL import Image
    except ImportError as e:
        raise ValueError("jpeg and webp need an image library, which is not installed") from e
    return Image


def encode_bands(bands: list[np.ndarray], kind: str, compression: str | None = "gzip", quality: int = 85) -> bytes:
    """Bands of equal size as one blob in which the bands of a pixel stand together. The lossy codecs take bytes only,
    of one or three bands (jpeg) or also four (webp), and need an image library."""
    stacked = np.stack([np.asarray(b).ravel() for b in bands], axis=-1)
    if compression not in LOSSY:
        return encode(stacked, kind, compression)
    if kind != "uint8" or len(bands) not in LOSSY[compression] or not 1 <= quality <= 100:
        raise ValueError(f"{compression} takes {' or '.join(map(str, LOSSY[compression]))} bands of uint8 and a quality from 1 to 100")
    side = math.isqrt(len(stacked))
    picture = _pictures().fromarray(stacked.astype(np.uint8).reshape(side, side, len(bands)) if len(bands) > 1 else stacked.astype(np.uint8).reshape(side, side))
    out = io.BytesIO()
    picture.save(out, format=compression.upper(), quality=quality)
    return out.getvalue()


def decode_bands(blob: bytes, kind: str, count: int, compression: str | None = None) -> np.ndarray:
    """An array of count rows, one a band."""
    if compression in LOSSY:
        return np.asarray(_pictures().open(io.BytesIO(blob)), np.uint8).reshape(-1, count).T
    return decode(blob, kind, compression).reshape(-1, count).T


def fitted(values: np.ndarray, size: int, nodata: float | None) -> np.ndarray:
    """A tile of size x size: cropped, or padded with nodata (without one, NaN for floats and else 0)."""
    values = values[:size, :size]
    fill = nodata if nodata is not None else np.nan if values.dtype.kind == "f" else 0
    out = np.full((size, size), fill, values.dtype)
    out[: values.shape[0], : values.shape[1]] = values
    return out


def valid(values: np.ndarray, nodata=None) -> np.ndarray:
    """Mask of the pixels that count: finite and not nodata."""
    nodata = nodata_value(nodata)
    mask = np.isfinite(values) if values.dtype.kind == "f" else np.ones(values.shape, bool)
    if nodata is not None and nodata == nodata:
        mask &= values != (np.asarray(nodata).astype(values.dtype) if values.dtype.kind == "f" else nodata)
    return mask


def without_outliers(values: np.ndarray) -> np.ndarray:
    """Values within ten interquartile ranges of the quartiles, if there are over 100."""
    if len(values) <= 100:
        return values
    a, b = np.percentile(values, [25, 75])
    return values[(values >= a - 10 * (b - a)) & (values <= b + 10 * (b - a))]


def encode_udf(kind: str, compression: str | None = "gzip"):
    """A function of an array column of numbers that gives its blob; nulls stay null."""

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda v: None if v is None else encode(np.asarray(v, "f8"), kind, compression))

    return run


def decode_udf(kind: str, compression: str | None = None, scale: float = 1.0, offset: float = 0.0, nodata=None):
    """A function of a blob column that gives its pixels as doubles, scaled; nodata pixels are null."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda b: None if b is None else _physical(decode(b, kind, compression), scale, offset, nodata))

    return run


def _physical(values: np.ndarray, scale: float, offset: float, nodata) -> list:
    mask = valid(values, nodata)
    out = values.astype("f8") * scale + offset
    return out.tolist() if mask.all() else [v if m else None for v, m in zip(out.tolist(), mask.tolist(), strict=True)]


def plain_udf(kind: str):
    """A function of a blob that gives it without compression."""

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda b: None if b is None else decode(b, kind).tobytes())

    return run


def interleave_udf(kind: str, compression: str | None = "gzip", quality: int = 85):
    """A function of an array of single-band blobs that gives one blob of all bands, pixel by pixel."""

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda bands: None if bands is None else encode_bands([decode(b, kind) for b in bands], kind, compression, quality))

    return run


def band_of_udf(kind: str, count: int, band: int, compression: str | None = None):
    """A function of an interleaved blob that gives one band, from 1, as a blob of its own."""

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda b: None if b is None else encode(decode_bands(b, kind, count, compression)[band - 1], kind))

    return run


def is_empty_udf(kind: str, nodata=None, compression: str | None = None):
    """Whether no pixel of a blob is valid; a null blob is empty."""

    @F.pandas_udf("boolean")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda b: b is None or not valid(decode(b, kind, compression), nodata).any())

    return run


def combine_udf(function, kind: str, out: str = "float64", nodata=None, compression: str | None = None):
    """A function of two blob columns: function(a, b) pixel by pixel over doubles as a blob; what is nodata in
    either, or not finite in the result, is NaN (0 for integer results)."""

    @F.pandas_udf("binary")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series([None if x is None or y is None else _combined(function, decode(x, kind, compression), decode(y, kind, compression), out, nodata) for x, y in zip(a, b, strict=True)])

    return run


def _combined(function, a: np.ndarray, b: np.ndarray, out: str, nodata) -> bytes:
    mask = valid(a, nodata) & valid(b, nodata)
    with np.errstate(all="ignore"):
        v = function(a.astype("f8"), b.astype("f8"))
    v = np.where(mask & np.isfinite(v), v, np.nan)
    return encode(np.nan_to_num(v) if out[0] != "f" else v, out)


def normalized_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(a - b) / (a + b), NaN where the sum is 0."""
    return np.divide(a - b, a + b, out=np.full(len(a), np.nan), where=(a + b) != 0)


def masked_where(a: np.ndarray, b: np.ndarray, nodata: float = -9999.0) -> np.ndarray:
    """a, but nodata where b is 0."""
    return np.where(b == 0, nodata, a)


def display_udf(kind: str, compression: str | None = None):
    """A function of a blob that gives its pixels as bytes for display: 8 bits as they are, 16 bits by their
    high byte, others stretched over 0 to 255 by the tile's least and largest finite value."""

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda b: None if b is None else display(decode(b, kind, compression)).tobytes())

    return run


def display(values: np.ndarray) -> np.ndarray:
    if values.dtype == np.uint8:
        return values
    if values.dtype == np.uint16:
        return (values >> 8).astype(np.uint8)
    v = values.astype("f8")
    good = np.isfinite(v)
    if not good.any():
        return np.zeros(len(v), np.uint8)
    low, high = v[good].min(), v[good].max()
    out = np.zeros(len(v)) if high == low else (np.where(good, v, low) - low) / (high - low) * 255
    return out.astype(np.uint8)


def pixels(values: Column, size: int) -> Column:
    """An array of structs px, py, value from a decoded tile."""
    return F.transform(values, lambda v, i: F.struct((i % size).alias("px"), F.floor(i / size).cast("int").alias("py"), v.alias("value")))
