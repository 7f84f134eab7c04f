"""SQL names for the functions over cells, tiles and pixels."""

from __future__ import annotations

import json
import re
import uuid
import warnings
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

from tilecairn.functions.cells import BASE, EVEN, LOW52, ZOOM_BITS, tile_of
from tilecairn.functions.geometry import Area, auto_zoom, cover, parse_point, parse_wkt, pixel_mask, relation
from tilecairn.functions.mercator import EDGE, tile_at, tile_box
from tilecairn.functions.pixels import _combined, combine_udf, decode, decode_udf, is_empty_udf, normalized_difference, valid
from tilecairn.functions.stats import NAMES, STATS, frame, summary, summary_udf
from tilecairn.operators.zonal import value_udf
from tilecairn.sources import tables
from tilecairn.sources.metadata import parse


def _spread(v: str) -> str:
    return f"cast(conv(bin({v}), 4, 10) as bigint)"


def _compact(v: str) -> str:
    return f"cast(conv(conv(cast({v} & {EVEN}L as string), 10, 4), 2, 10) as bigint)"


_Z = "cast(shiftrightunsigned(c, 52) & 31L as int)"
_M = f"shiftrightunsigned(c & {LOW52}L, 52 - 2 * {_Z})"
#: SQL functions: name and arguments, type, body. They are expressions, inlined by the optimizer.
FUNCTIONS = {
    "cell_from_tile(x BIGINT, y BIGINT, z INT)": ("BIGINT", f"{BASE}L | shiftleft(cast(z as bigint), 52) | shiftleft({_spread('x')} | shiftleft({_spread('y')}, 1), 52 - 2 * z) | (shiftleft(1L, 52 - 2 * z) - 1L)"),
    "cell_resolution(c BIGINT)": ("INT", _Z),
    "cell_x(c BIGINT)": ("BIGINT", _compact(_M)),
    "cell_y(c BIGINT)": ("BIGINT", _compact(f"shiftrightunsigned({_M}, 1)")),
    "cell_parent(c BIGINT, p INT)": ("BIGINT", f"(c & {~ZOOM_BITS}L) | shiftleft(cast(p as bigint), 52) | (shiftleft(1L, 52 - 2 * p) - 1L)"),
    "st_point(lon DOUBLE, lat DOUBLE)": ("STRING", "concat('POINT(', lon, ' ', lat, ')')"),
    "st_geomfromtext(t STRING)": ("STRING", "t"),
    "cell_from_point(lon DOUBLE, lat DOUBLE, z INT)": ("BIGINT", f"cell_from_tile(least(greatest(floor((lon / 360.0D + 0.5D) * shiftleft(1L, z)), 0L), shiftleft(1L, z) - 1L), least(greatest(floor((0.5D - 0.25D * ln((1 + sin(radians(least(greatest(lat, -{EDGE}D), {EDGE}D)))) / (1 - sin(radians(least(greatest(lat, -{EDGE}D), {EDGE}D))))) / pi()) * shiftleft(1L, z)), 0L), shiftleft(1L, z) - 1L), z)"),
}


def register(spark: SparkSession, bands: dict[str, tuple] | None = None) -> None:
    """Register the cell functions as temporary SQL functions, and for each named kind of band, such as
    {"dem": ("float32", -9999, 256)} (pixel type, nodata, block size), raster_stats_<name>(blob),
    raster_pixels_<name>(blob), raster_value_<name>(blob, px, py), raster_empty_<name>(blob) and
    raster_difference_<name>(blob, blob), whose float64 blobs raster_pixels_doubles(blob) reads."""
    for name, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS {kind} RETURN {body}")
    for name, (kind, nodata, size) in (bands or {}).items():
        spark.udf.register(f"raster_stats_{name}", summary_udf(kind, nodata))
        spark.udf.register(f"raster_pixels_{name}", decode_udf(kind, nodata=nodata))
        spark.udf.register(f"raster_value_{name}", value_udf(kind, size, nodata))
        spark.udf.register(f"raster_empty_{name}", is_empty_udf(kind, nodata))
        spark.udf.register(f"raster_difference_{name}", combine_udf(normalized_difference, kind, nodata=nodata))
        spark.udf.register("raster_pixels_doubles", decode_udf("float64"))


# Functions that take what they need to know from the metadata, as text.


@lru_cache(maxsize=64)
def _entry(text: str, band: int) -> tuple[str, object, str | None, int]:
    """Pixel type, nodata, compression and block size of a band (from 1)."""
    meta = parse(text)
    b = meta["bands"][band - 1]
    return b["type"], b.get("nodata"), meta.get("compression"), meta["tiling"]["block_width"]


@lru_cache(maxsize=256)
def _area(text: str) -> Area:
    return parse_wkt(text)


def _rows(columns: tuple[pd.Series, ...]):
    return zip(*columns, strict=True)


def _value(block, blob, point, text, band=1) -> float | None:
    kind, nodata, compression, size = _entry(text, int(band))
    lon, lat = parse_point(point)
    x, y, z = tile_of(int(block))
    n = (1 << z) * size
    px, py = tile_at(lon, lat, z + size.bit_length() - 1)
    if (px // size, py // size) != (x, y) or not 0 <= px < n:
        return None
    values = decode(blob, kind, compression)
    at = py % size * size + px % size
    return float(values[at]) if valid(values, nodata)[at] else None


def _stats(blob, text, band=1) -> dict | None:
    kind, nodata, compression, _ = _entry(text, int(band))
    return summary(decode(blob, kind, compression), nodata)


def _part(blob, block, geometry, text, band=1) -> dict | None:
    kind, nodata, compression, size = _entry(text, int(band))
    return summary(decode(blob, kind, compression), nodata, mask=pixel_mask(_area(geometry), *tile_of(int(block)), size))


def _clipped(blob, block, geometry, text, band=1) -> list[dict]:
    kind, nodata, compression, size = _entry(text, int(band))
    values = decode(blob, kind, compression)
    at = np.flatnonzero(valid(values, nodata) & pixel_mask(_area(geometry), *tile_of(int(block)), size))
    return [{"px": int(i % size), "py": int(i // size), "value": float(values[i])} for i in at]


def _difference(a, b, text) -> bytes:
    """The normalized difference of two bands as deflated doubles, NaN without a value."""
    kind, nodata, compression, _ = _entry(text, 1)
    return _combined(normalized_difference, decode(a, kind, compression), decode(b, kind, compression), "float64", nodata)


def _difference_stats(a, b, text) -> dict | None:
    return summary(decode(_difference(a, b, text), "float64"))


def _meets(block, geometry) -> bool:
    x, y, z = tile_of(int(block))
    if geometry.lstrip()[:5].upper() == "POINT":
        return tile_at(*parse_point(geometry), z) == (x, y)
    return relation(_area(geometry), tile_box(x, y, z)) != "outside"


def _udf(function, kind: str):
    """A pandas function of as many columns as it is called with; a null argument gives a null."""

    def run(*columns):
        out = [None if any(v is None or v != v for v in row) else function(*row) for row in _rows(columns)]
        return frame(out) if kind == STATS else pd.Series(out, dtype=object)

    with warnings.catch_warnings():  # type hints can't say that there may be any number of columns
        warnings.simplefilter("ignore", UserWarning)
        return F.pandas_udf(run, kind, PandasUDFType.SCALAR)


#: SQL names and types of these functions.
RASTER_FUNCTIONS = {
    "st_rastervalue": (_value, "double"),
    "st_rastersummarystats": (_stats, STATS),
    "raster_region_part": (_part, STATS),
    "st_clip": (_clipped, "array<struct<px:int,py:int,value:double>>"),
    "st_normalizeddifference": (_difference, "binary"),
    "st_normalizeddifferencestats": (_difference_stats, STATS),
    "st_intersects": (_meets, "boolean"),
}
#: How calls are written out before Spark reads them: {0}, {1}, ... are the arguments, {all} all of them.
MACROS = {
    "st_rastersummarystat": lambda a: f"element_at(map({', '.join(chr(39) + n + chr(39) + ', cast(st_rastersummarystats(' + a[1] + ', ' + a[3] + ').' + n + ' as double)' for n in NAMES)}), lower({a[2]}))",
    "st_regionstats": lambda a: _merge_sql(f"raster_region_part({', '.join(a)})"),
    "st_mergestats": lambda a: _merge_sql(a[0]),
    # the same functions in another dialect, without metadata, which the rows have
    "raster_st_value": lambda a: f"st_rastervalue({a[0]}, {a[1]}, {a[2]}, metadata)",
    "raster_st_summarystats": lambda a: f"st_rastersummarystats({a[1]}, metadata)",
    "raster_st_clip": lambda a: f"st_clip({a[1]}, {a[0]}, {a[2]}, metadata)",
    "raster_st_intersects": lambda a: f"st_intersects({a[0]}, {a[1]})",
    "st_rasterintersects": lambda a: f"st_intersects({a[0]}, {a[1]})",
    "st_geogpoint": lambda a: f"st_point({a[0]}, {a[1]})",
    "st_geogfromtext": lambda a: f"st_geomfromtext({a[0]})",
}


def _merge_sql(s: str) -> str:
    """SQL aggregates that merge STATS exactly, from partial sums."""
    mean = f"try_divide(sum({s}.sum), sum({s}.count))"
    return f"named_struct('count', sum({s}.count), 'sum', sum({s}.sum), 'mean', {mean}, 'min', min({s}.min), 'max', max({s}.max), 'stddev', sqrt(greatest(try_divide(sum({s}.sum_squares), sum({s}.count)) - {mean} * {mean}, 0.0D)))"


def _calls(text: str, names: list[str]):
    """The innermost-last calls of functions in SQL text: start, end, name, arguments; quoted text is passed over."""
    wanted = re.compile(r"'(?:[^']|'')*'|\b(" + "|".join(names) + r")\s*\(", re.I)
    for m in wanted.finditer(text):
        if m[1] is None:
            continue
        depth, at, start, args = 1, m.end(), m.end(), []
        while at < len(text) and depth:
            c = text[at]
            if c == "'":
                at = text.find("'", at + 1)
                if at < 0:
                    raise ValueError("a quote is not closed")
            elif c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
            if depth == 1 and c == "," or not depth:
                args.append(text[start:at].strip())
                start = at + 1
            at += 1
        if depth:
            raise ValueError(f"a parenthesis of {m[1]} is not closed")
        yield m.start(), at, m[1].lower(), [a for a in args if a]


def _spread_out(text: str) -> str:
    """(struct).* as a generator of its fields, and casts to geometry left out; quoted text is passed over."""
    text = re.sub(r"('(?:[^']|'')*')|::\s*(?:GEOMETRY|GEOGRAPHY)\b", lambda m: m[1] or "", text, flags=re.I)
    opened, found, quoted = [], [], False
    for i, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif not quoted and c == "(":
            opened.append(i)
        elif not quoted and c == ")" and opened:
            start = opened.pop()
            if star := re.match(r"\)\s*\.\s*\*", text[i:]):
                found.append((start, i, i + star.end()))
    for start, end, after in reversed(found):
        text = f"{text[:start]}inline(array({text[start + 1 : end]})){text[after:]}"
    return text


def _literal(arg: str) -> str | float:
    """The value of a literal argument: text, a number, or st_point() of two numbers."""
    if m := re.fullmatch(r"st_point\s*\(([^,]+),([^,]+)\)", arg, re.I):
        return f"POINT({float(m[1])} {float(m[2])})"
    if m := re.fullmatch(r"(?:st_geomfromtext\s*\()?\s*'((?:[^']|'')*)'\s*\)?", arg, re.I):
        return m[1].replace("''", "'")
    return float(arg)


def ranges_sql(geometry: str, block: str, most: int = 4) -> str:
    """The ranges of ids of all zooms in which tiles that meet an area lie, as SQL that readers prune by."""
    area = parse_wkt(geometry)
    found = cover(area, auto_zoom(area, 0, 20, 256))
    spans = []
    for z in range(27):
        for first, last in found.merged(most):
            # from the cells of one zoom to their ancestors or descendants
            low = (1 << (52 - 2 * min(z, found.zoom))) - 1
            first_, last_ = first & ~ZOOM_BITS & ~low | z << 52, last & ~ZOOM_BITS | low | z << 52
            spans.append((first_, last_))
    return "(" + " OR ".join(f"{block} BETWEEN {a} AND {b}" for a, b in spans) + ")"


def _table(spark: SparkSession, name: str, args: list) -> DataFrame:
    path = args[0]
    if name == "read_tiles_metadata":
        return tables.metadata_table(spark, path)
    if name == "read_tiles_at":
        return _told(spark, path, tables.read_at(spark, path, args[1], args[2], int(args[3]) if len(args) > 3 else None))
    if len(args) == 1:
        return tables.read_table(spark, path, metadata=True)
    zoom = args[2] if len(args) > 2 else None
    zoom = int(zoom) if isinstance(zoom, float) else zoom
    if str(args[1]).lstrip()[:5].upper() == "POINT":
        return _told(spark, path, tables.read_at(spark, path, *parse_point(args[1]), zoom))
    return _told(spark, path, tables.read_region(spark, path, parse_wkt(args[1]), zoom))


def _told(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    return df.withColumn("metadata", F.lit(json.dumps(tables.cached_metadata(spark, path))))


def query(spark: SparkSession, text: str) -> DataFrame:
    """Run SQL with raster functions and table functions over tables of tiles; the plan is Spark's own.

    Table functions, with literal arguments: read_tiles('path'), the data rows with the metadata on each;
    read_tiles('path', 'POLYGON ...' or st_point(lon, lat)[, zoom or 'auto', 'min', 'max']), the tiles that an area
    meets; read_tiles_at('path', lon, lat[, zoom]); read_tiles_metadata('path').

    Functions: st_point(lon, lat), st_geomfromtext(text); st_rastervalue(block, band, point, metadata),
    st_rastersummarystats(band, metadata), st_rastersummarystat(block, band, 'mean', metadata), st_clip(band,
    block, area, metadata), st_intersects(block, area), st_normalizeddifference(a, b, metadata),
    st_normalizeddifferencestats(a, b, metadata); a last argument may name the place of the band in the metadata, from 1.
    raster_st_value(), raster_st_summarystats(), raster_st_intersects() and raster_st_clip() take block, band and what
    else they need, but no metadata. Aggregates: st_regionstats(band, block, area, metadata) and st_mergestats(stats), which become partial
    sums. st_intersects() with a literal area also becomes ranges of ids, which readers prune by. (struct).* and
    casts to GEOMETRY are understood.
    """
    text = _spread_out(text)
    register(spark)
    for name, (function, kind) in RASTER_FUNCTIONS.items():
        spark.udf.register(name, _udf(function, kind))
    reads = ["read_tiles_metadata", "read_tiles_at", "read_tiles"]
    while found := list(_calls(text, list(MACROS))):
        start, end, name, args = found[-1]
        text = text[:start] + MACROS[name](args) + text[end:]
    for start, end, name, args in reversed(list(_calls(text, reads))):
        view = f"_tiles_{uuid.uuid4().hex}"
        _table(spark, name, [_literal(a) for a in args]).createOrReplaceTempView(view)
        text = text[:start] + view + text[end:]
    for start, end, _, args in reversed(list(_calls(text, ["st_intersects"]))):
        if len(args) == 2 and re.fullmatch(r"(?:st_geomfromtext\s*\()?\s*'[^']*'\s*\)?", args[1], re.I):
            text = text[:start] + f"({ranges_sql(_literal(args[1]), args[0])} AND {text[start:end]})" + text[end:]
    return spark.sql(text)
