"""Web-Mercator tiles: from longitude and latitude, bounds, and choices of zoom."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilecairn.functions.cells import _long, left, tile_to_cell

RADIUS = 6378137.0
CIRCLE = 2 * math.pi * RADIUS
#: Latitude at which the square world ends.
EDGE = 85.0511287798066
#: Pixels of diagonal below which no smaller overview is made.
LEAST_OVERVIEW = 128


def _size(zoom: Column | int) -> Column:
    return left(1, _long(zoom)).cast("double")


def _limited(v: Column, zoom: Column | int) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(v, left(1, _long(zoom)) - 1))


def fraction_x(lon: Column, zoom: Column | int) -> Column:
    return (lon / 360.0 + 0.5) * _size(zoom)


def fraction_y(lat: Column, zoom: Column | int) -> Column:
    s = F.sin(F.radians(lat))
    return (0.5 - 0.25 * F.log((1 + s) / (1 - s)) / math.pi) * _size(zoom)


def tile_x(lon: Column, zoom: Column | int) -> Column:
    return _limited(F.floor(fraction_x(lon, zoom)), zoom)


def tile_y(lat: Column, zoom: Column | int) -> Column:
    return _limited(F.floor(fraction_y(F.greatest(F.lit(-EDGE), F.least(lat, F.lit(EDGE))), zoom)), zoom)


def point_to_cell(lon: Column, lat: Column, zoom: Column | int) -> Column:
    """The cell under a point; points beyond the square world fall into its outermost cells."""
    return tile_to_cell(tile_x(lon, zoom), tile_y(lat, zoom), zoom)


def west(x: Column, zoom: Column | int) -> Column:
    return x / _size(zoom) * 360.0 - 180.0


def north(y: Column, zoom: Column | int) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / _size(zoom)))))


def bounds(x: Column, y: Column, zoom: Column | int) -> Column:
    """A struct of west, south, east and north in degrees."""
    return F.struct(west(x, zoom).alias("west"), north(y + 1, zoom).alias("south"), west(x + 1, zoom).alias("east"), north(y, zoom).alias("north"))


def metre_bounds(x: Column, y: Column, zoom: Column | int) -> Column:
    """A struct of left, bottom, right and top in Mercator metres."""
    unit = CIRCLE / _size(zoom)
    edge = CIRCLE / 2
    return F.struct((x * unit - edge).alias("left"), (edge - (y + 1) * unit).alias("bottom"), ((x + 1) * unit - edge).alias("right"), (edge - y * unit).alias("top"))


def bbox_tiles(w: Column, s: Column, e: Column, n: Column, zoom: Column | int) -> Column:
    """An array of structs x, y: the tiles that a box in degrees meets, row by row; a box with w > e crosses
    the antimeridian. An edge that lies on a tile border adds no tiles."""
    nudge = 1e-11
    z = _long(zoom)
    far = left(1, z) - 1
    span = lambda a, b: F.sequence(tile_x(F.greatest(F.lit(-180.0), a), z), F.greatest(tile_x(F.greatest(F.lit(-180.0), a), z), tile_x(F.least(F.lit(180.0), b) - nudge, z)))
    xs = F.when(w <= e, span(w, e)).otherwise(F.concat(F.sequence(tile_x(w, z), far), F.sequence(F.lit(0).cast("long"), tile_x(e - nudge, z))))
    ys = F.sequence(tile_y(n, z), F.greatest(tile_y(n, z), tile_y(s + nudge, z)))
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("x"), y.alias("y")))))


def children(x: Column, y: Column, zoom: Column | int, box: tuple[Column, Column, Column, Column]) -> Column:
    """An array of structs x, y: the tiles one zoom down within a tile, of those that a box in degrees meets."""
    z = _long(zoom)
    w, s, e, n = box
    inner = (F.greatest(w, west(x, z)), F.greatest(s, north(y + 1, z)), F.least(e, west(x + 1, z)), F.least(n, north(y, z)))
    met = (inner[0] < inner[2]) & (inner[1] < inner[3])
    own = lambda t: (F.shiftright(t["x"], 1) == x) & (F.shiftright(t["y"], 1) == y)
    return F.when(met, F.filter(bbox_tiles(*inner, z + 1), own)).otherwise(F.array().cast("array<struct<x:bigint,y:bigint>>"))


def zoom_for(resolution: Column, strategy: str = "auto", block_zoom: int = 8) -> Column:
    """The zoom whose pixels are nearest to a resolution in metres: the finer (upper), the coarser (lower), or
    by rounding half to even (auto)."""
    exact = F.log2(F.lit(CIRCLE) / math.pow(2, block_zoom) / resolution)
    return {"upper": F.ceil, "lower": F.floor, "auto": F.bround}[strategy](exact).cast("int")


def least_zoom(width: Column, height: Column, zoom: Column, block_zoom: int = 8) -> Column:
    """The zoom at which a raster of so many pixels at ``zoom`` has a diagonal near LEAST_OVERVIEW."""
    diagonal = F.sqrt(width * width + height * height)
    up = F.bround(F.log2(diagonal / LEAST_OVERVIEW))
    return F.greatest(F.lit(0), F.least(zoom, zoom - up)).cast("int")


def target_zoom(width_metres: Column, width_pixels: Column, block_zoom: int = 8) -> Column:
    """The zoom for a service that gives its extent and pixels, within what cell ids can hold."""
    return F.greatest(F.lit(0), F.least(F.lit(26 - block_zoom), F.ceil(F.log2(F.lit(CIRCLE) / math.pow(2, block_zoom) / (width_metres / width_pixels))))).cast("int")


def clamped_zoom(zoom: Column, least: Column | int, most: Column | int) -> Column:
    """The zoom of a table that a wanted zoom falls back to."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(as_col(least), F.least(as_col(most), zoom))


def metres(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees as Mercator metres."""
    return lon * (CIRCLE / 360), F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * RADIUS


def degrees(x: Column, y: Column) -> tuple[Column, Column]:
    return x * (360 / CIRCLE), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - math.pi / 2)


def native_resolution(width: Column, height: Column, left_: Column, bottom: Column, right_: Column, top: Column) -> Column:
    """Metres a pixel along the diagonal of a raster's outer bounds."""
    ground = F.sqrt(F.pow(right_ - left_, 2) + F.pow(top - bottom, 2))
    return ground / F.sqrt(width * width + height * height)


def outer_bounds(corners: list[tuple[Column, Column]]) -> Column:
    """A struct of the box around four corners."""
    xs, ys = zip(*corners, strict=True)
    return F.struct(F.least(*xs).alias("left"), F.least(*ys).alias("bottom"), F.greatest(*xs).alias("right"), F.greatest(*ys).alias("top"))


def clipped_window(origin: Column, step: Column, count: Column) -> Column:
    """A struct of the first pixel and the number of pixels, along one axis, that lie in the square world."""
    edge = CIRCLE / 2
    a, b = (-edge - origin) / step, (edge - origin) / step
    first = F.greatest(F.lit(0).cast("long"), F.floor(F.least(a, b)))
    last = F.least(count, F.ceil(F.greatest(a, b)))
    return F.struct(first.alias("first"), F.greatest(F.lit(0).cast("long"), last - first).alias("count"))


def crs_name(wkid: Column, wkt: Column) -> Column:
    """The name of a spatial reference: known ids of Web Mercator, other ids as EPSG codes, then text."""
    named = F.when(wkid == 102100, "EPSG:3857").when(wkid == 102113, "EPSG:3785").when(wkid.isNotNull(), F.concat(F.lit("EPSG:"), wkid.cast("string")))
    return F.coalesce(named, wkt, F.lit("EPSG:4326"))


def is_web_mercator(crs: Column) -> Column:
    return F.upper(crs).isin("EPSG:3857", "EPSG:900913", "EPSG:102100")


def export_transform(zoom: Column | int, block_zoom: int = 8) -> Column:
    """The geotransform of the world at a zoom: pixel size and top left corner in metres."""
    unit = CIRCLE / math.pow(2, block_zoom) / _size(zoom)
    edge = F.lit(CIRCLE / 2)
    return F.array(unit, F.lit(0.0), -edge, F.lit(0.0), -unit, edge)


def bucket_to_virtual(path: Column) -> Column:
    return F.regexp_replace(path, "^gs://", "/vsigs/")


def virtual_to_bucket(path: Column) -> Column:
    return F.regexp_replace(path, "^/vsigs/", "gs://")


def matching_overview(reductions: Column, wanted: Column, tolerance: float = 0.1) -> Column:
    """The place, from 0, of the first reduction within the tolerance of the wanted one; null if none is."""
    near = F.filter(F.sequence(F.lit(0), F.size(reductions) - 1), lambda i: F.abs(F.get(reductions, i) - wanted) <= tolerance * wanted)
    return F.when(F.size(reductions) > 0, F.get(near, F.lit(0)))


# The same for single values on the driver.


def tile_at(lon: float, lat: float, z: int) -> tuple[int, int]:
    lat = max(-EDGE, min(EDGE, lat))
    s = math.sin(math.radians(lat))
    n = 1 << z
    clamp = lambda v: max(0, min(n - 1, math.floor(v)))
    return clamp((lon / 360 + 0.5) * n), clamp((0.5 - 0.25 * math.log((1 + s) / (1 - s)) / math.pi) * n)


def tile_box(x: int, y: int, z: int) -> tuple[float, float, float, float]:
    """West, south, east and north of a tile in degrees."""
    n = 1 << z
    lat = lambda v: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * v / n))))
    return x / n * 360 - 180, lat(y + 1), (x + 1) / n * 360 - 180, lat(y)
