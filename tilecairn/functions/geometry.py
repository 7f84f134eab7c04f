"""Areas in degrees: well-known text, points in polygons, and the cells that cover an area.

A polygon's inside is by the even-odd rule over all its rings, half open: of a shared edge one side holds
the points. A tile that only touches an area is outside it. Areas across the antimeridian come as parts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from tilecairn.functions.cells import BASE, ZOOM_BITS
from tilecairn.functions.mercator import tile_at

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


@dataclass(frozen=True)
class Area:
    """Polygons, each a tuple of rings of (lon, lat); the first ring need not be the outer one."""

    polygons: tuple[tuple[tuple[tuple[float, float], ...], ...], ...]

    @property
    def box(self) -> tuple[float, float, float, float]:
        points = [p for polygon in self.polygons for ring in polygon for p in ring]
        lon, lat = zip(*points, strict=True)
        return min(lon), min(lat), max(lon), max(lat)

    @cached_property
    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """All edges as rows x0, y0, x1, y1, and the number of the polygon of each."""
        rows = [(*a, *b, i) for i, polygon in enumerate(self.polygons) for ring in polygon for a, b in zip(ring, ring[1:] + ring[:1], strict=True) if a != b]
        table = np.array(rows, float).reshape(-1, 5)
        return table[:, :4], table[:, 4].astype(int)

    def holds(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        """Whether points lie within."""
        shape = np.broadcast(lon, lat).shape
        lon, lat = (np.broadcast_to(v, shape).ravel() for v in (lon, lat))
        edges, polygon = self.edges
        inside = np.zeros(len(lon), bool)
        step = max(1, (1 << 22) // max(1, len(edges)))
        for i in range(len(self.polygons)):
            x0, y0, x1, y1 = (c[:, None] for c in edges[(polygon == i) & (edges[:, 1] != edges[:, 3])].T)
            for at in range(0, len(lon), step):
                x, y = lon[at : at + step], lat[at : at + step]
                odd = (((y0 > y) != (y1 > y)) & (x < x0 + (y - y0) * (x1 - x0) / (y1 - y0))).sum(axis=0) % 2 == 1
                inside[at : at + step] |= odd
        return inside.reshape(shape)


def box_area(w: float, s: float, e: float, n: float) -> Area:
    return Area((((((w, s), (e, s), (e, n), (w, n))),),))


def parse_wkt(text: str) -> Area:
    """The area of POLYGON or MULTIPOLYGON text, with an SRID of 4326 or none, and without Z or M."""
    m = re.match(r"\s*(?:SRID=4326;)?\s*(MULTIPOLYGON|POLYGON)\s*(\(.*\))\s*$", text, re.I | re.S)
    if not m:
        raise ValueError(f"not a polygon in well-known text: {text[:60]}")
    rings = lambda body: tuple(_ring(r) for r in re.findall(r"\(([^()]*)\)", body))
    if m[1].upper() == "POLYGON":
        polygons = (rings(m[2]),)
    else:
        polygons = tuple(rings(p) for p in re.findall(r"\(\s*(\([^()]*\)(?:\s*,\s*\([^()]*\))*)\s*\)", m[2][1:-1]))
    if not polygons or not all(polygons):
        raise ValueError("the area is empty")
    return Area(polygons)


def _ring(text: str) -> tuple[tuple[float, float], ...]:
    points = tuple(tuple(float(v) for v in re.findall(NUMBER, p)[:2]) for p in text.split(","))
    if any(len(p) != 2 for p in points):
        raise ValueError("a point has two numbers")
    points = points[:-1] if len(points) > 1 and points[0] == points[-1] else points
    if len(points) < 3:
        raise ValueError("a ring has three points at least")
    return points


def parse_point(text: str) -> tuple[float, float]:
    m = re.match(rf"\s*POINT\s*\(\s*({NUMBER})\s+({NUMBER})\s*\)\s*$", text, re.I)
    if not m:
        raise ValueError(f"not a point in well-known text: {text[:60]}")
    return float(m[1]), float(m[2])


def relation(area: Area, box: tuple[float, float, float, float]) -> str:
    """How a box of degrees lies to an area: "inside", "outside" or "boundary"."""
    w, s, e, n = box
    if _enters(area.edges[0], w, s, e, n).any():
        return "boundary"
    return "inside" if area.holds(np.array((w + e) / 2), np.array((s + n) / 2)) else "outside"


def _enters(edges: np.ndarray, w, s, e, n) -> np.ndarray:
    """Whether edges pass through open boxes (one for all or one each; clipped line by line)."""
    x0, y0, x1, y1 = edges.T
    dx, dy = x1 - x0, y1 - y0
    low, high = np.zeros(len(edges)), np.ones(len(edges))
    ok = np.ones(len(edges), bool)
    for d, a, first, last in ((dx, x0, w, e), (dy, y0, s, n)):
        still = d == 0
        ok &= ~still | ((a > first) & (a < last))
        with np.errstate(divide="ignore", invalid="ignore"):
            p, q = (first - a) / d, (last - a) / d
        p, q = np.where(still, 0.0, np.minimum(p, q)), np.where(still, 1.0, np.maximum(p, q))
        low, high = np.maximum(low, p), np.minimum(high, q)
    return ok & (low < high)


class Cover:
    """The cells of one zoom that an area meets, as sorted ranges of ids: first, last, and whether wholly inside. A range
    is that of one tile's descendants, from the least id that any could have; single cells on the boundary are
    both ends."""

    def __init__(self, zoom: int, first: np.ndarray, last: np.ndarray, inside: np.ndarray):
        order = np.argsort(first)
        self.zoom, self.first, self.last, self.inside = zoom, first[order], last[order], inside[order]

    @property
    def ranges(self) -> list[tuple[int, int, bool]]:
        return list(zip(self.first.tolist(), self.last.tolist(), self.inside.tolist(), strict=True))

    def part(self, inside: bool) -> Cover:
        """The ranges wholly inside, or the others."""
        at = self.inside == inside
        return Cover(self.zoom, self.first[at], self.last[at], self.inside[at])

    def place(self, ids: np.ndarray) -> np.ndarray:
        """Of each id of the zoom the place of its range; -1 where it is in none."""
        if not len(self.first):
            return np.full(len(ids), -1)
        at = np.searchsorted(self.first, ids, side="right") - 1
        return np.where((at >= 0) & (ids <= self.last[np.maximum(at, 0)]), at, -1)

    def merged(self, most: int = 32) -> list[tuple[int, int]]:
        """At most so many ranges that hold all of them; the smallest gaps are closed first."""
        if not len(self.first):
            return []
        gaps = self.first[1:] - self.last[:-1]
        apart = np.flatnonzero(gaps > 1 << (52 - 2 * self.zoom))
        if len(apart) >= most:
            apart = np.sort(apart[np.argsort(-gaps[apart], kind="stable")[: most - 1]])
        starts, ends = np.concatenate([[0], apart + 1]), np.concatenate([apart, [len(self.first) - 1]])
        return list(zip(self.first[starts].tolist(), self.last[ends].tolist(), strict=True))


def _cells(x: np.ndarray, y: np.ndarray, z: int) -> np.ndarray:
    """Cell ids of tiles."""
    code = np.zeros(len(x), np.int64)
    for i in range(z):
        code |= (x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1
    return BASE | z << 52 | code << (52 - 2 * z) | (1 << (52 - 2 * z)) - 1


def _boxes(x: np.ndarray, y: np.ndarray, z: int) -> tuple[np.ndarray, ...]:
    """West, south, east and north of tiles in degrees."""
    n = 1 << z
    lat = lambda v: np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * v / n))))
    return x / n * 360 - 180, lat(y + 1), (x + 1) / n * 360 - 180, lat(y)


def cover(area: Area, zoom: int, mode: str = "intersects") -> Cover:
    """The cells at a zoom that an area meets (intersects), holds wholly (contains) or by their centre (center).

    From the smallest tile around the area down, level by level: a tile wholly inside is one range of
    descendants, one that the boundary passes is split, and only the edges that pass a tile are tried on its
    children, so a level takes time in proportion to the tiles on the boundary.
    """
    if mode not in ("intersects", "contains", "center"):
        raise ValueError(f"unknown mode {mode}")
    w, s, e, n = area.box
    z = zoom
    x0, y0 = tile_at(w, n, zoom)
    x1, y1 = tile_at(e, s, zoom)
    while z and (x0 != x1 or y0 != y1):
        x0, y0, x1, y1, z = x0 >> 1, y0 >> 1, x1 >> 1, y1 >> 1, z - 1
    edges = area.edges[0]
    x, y = np.array([x0], np.int64), np.array([y0], np.int64)
    tile, edge = np.zeros(len(edges), int), np.arange(len(edges))  # pairs of a tile and an edge that may pass it
    first, last, inside = [], [], []

    def take(cells: np.ndarray, ends: np.ndarray, within: bool) -> None:
        first.append(cells)
        last.append(ends)
        inside.append(np.full(len(cells), within))

    while len(x):
        box = _boxes(x, y, z)
        passes = _enters(edges[edge], *(c[tile] for c in box))
        tile, edge = tile[passes], edge[passes]
        crossed = np.zeros(len(x), bool)
        crossed[tile] = True
        free = np.flatnonzero(~crossed)
        middle = area.holds((box[0][free] + box[2][free]) / 2, (box[1][free] + box[3][free]) / 2)
        found = free[middle]
        cells, low = _cells(x[found], y[found], z), (1 << (52 - 2 * z)) - 1
        start = cells & ~ZOOM_BITS & ~low | zoom << 52
        take(start, start | low, True)
        if z == zoom:
            on = np.flatnonzero(crossed)
            if mode == "center":
                on = on[area.holds((box[0][on] + box[2][on]) / 2, _middle(y[on], z))]
            if mode != "contains":
                take(_cells(x[on], y[on], z), _cells(x[on], y[on], z), False)
            break
        on = np.flatnonzero(crossed)
        place = np.cumsum(crossed) - 1
        corner = np.arange(4)
        x, y = (2 * x[on, None] + corner % 2).ravel(), (2 * y[on, None] + corner // 2).ravel()
        tile, edge = (4 * place[tile][:, None] + corner).ravel(), np.repeat(edge, 4)
        z += 1
    return Cover(zoom, *(np.concatenate(c) for c in (first, last, inside)))


def _middle(y: np.ndarray, z: int) -> np.ndarray:
    """Latitudes of the middles of rows of tiles, in Mercator."""
    return np.degrees(np.arctan(np.sinh(np.pi * (1 - (2 * y + 1) / (1 << z)))))


def auto_zoom(area: Area, least: int, most: int, tiles: int = 64) -> int:
    """The finest zoom of a table at which the area's box spans at most so many tiles; else the coarsest."""
    w, s, e, n = area.box
    for z in range(most, least, -1):
        (x0, y0), (x1, y1) = tile_at(w, n, z), tile_at(e, s, z)
        if (x1 - x0 + 1) * (y1 - y0 + 1) <= tiles:
            return z
    return least


def pixel_centres(x: int, y: int, z: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Longitudes and latitudes of the centres of a tile's pixels, row by row."""
    n = (1 << z) * size
    lon = (x * size + np.arange(size) + 0.5) / n * 360 - 180
    lat = np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * (y * size + np.arange(size) + 0.5) / n))))
    return np.tile(lon, size), np.repeat(lat, size)


def pixel_mask(area: Area, x: int, y: int, z: int, size: int) -> np.ndarray:
    """Of a tile's pixels those whose centre lies in the area."""
    return area.holds(*pixel_centres(x, y, z, size))
