"""Reference systems that need no library: degrees, Mercator metres and the zones of UTM, over arrays."""

from __future__ import annotations

import re

import numpy as np

from tilecairn.functions.mercator import CIRCLE, EDGE, RADIUS

# Codes of systems in degrees and of Web Mercator; the axes and flattening of the ellipsoid.
DEGREES, MERCATOR = (4326, 4269, 4258, 4979, 84), (3857, 900913, 102100, 102113, 3785)
AXIS, FLATTENING, SCALE = 6378137.0, 1 / 298.257223563, 0.9996
#: Families of UTM zones: code less the zone, and whether they lie south.
ZONES = {32600: False, 32700: True, 25800: False, 26900: False}


def code_of(crs: str) -> int:
    found = re.search(r"(\d+)\s*\"?\]*\s*$", crs)
    if not found:
        raise ValueError(f"unknown reference system {crs}")
    return int(found[1])


def _zone(code: int) -> tuple[int, bool]:
    for base, south in ZONES.items():
        if 1 <= code - base <= 60:
            return code - base, south
    raise ValueError(f"EPSG:{code} needs a projection library; degrees, Web Mercator and UTM zones do not")


def is_separable(crs: str) -> bool:
    """Whether x hangs on the longitude only and y on the latitude only."""
    code = code_of(crs)
    if code in DEGREES or code in MERCATOR:
        return True
    _zone(code)
    return False


def _series() -> tuple[float, tuple[float, float, float], tuple[float, float, float]]:
    n = FLATTENING / (2 - FLATTENING)
    a = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    return a, forward, back


def from_degrees(lon, lat, crs: str) -> tuple[np.ndarray, np.ndarray]:
    """Longitudes and latitudes in units of a reference system."""
    lon, lat = np.asarray(lon, float), np.asarray(lat, float)
    code = code_of(crs)
    if code in DEGREES:
        return lon, lat
    if code in MERCATOR:
        return lon * (CIRCLE / 360), RADIUS * np.arctanh(np.sin(np.radians(np.clip(lat, -EDGE, EDGE))))
    zone, south = _zone(code)
    a, forward, _ = _series()
    e = np.sqrt(FLATTENING * (2 - FLATTENING))
    s = np.sin(np.radians(lat))
    t = np.sinh(np.arctanh(s) - e * np.arctanh(e * s))
    away = np.radians(lon - (zone * 6 - 183))
    xi, eta = np.arctan2(t, np.cos(away)), np.arctanh(np.sin(away) / np.sqrt(1 + t * t))
    x = eta + sum(c * np.cos(2 * k * xi) * np.sinh(2 * k * eta) for k, c in enumerate(forward, 1))
    y = xi + sum(c * np.sin(2 * k * xi) * np.cosh(2 * k * eta) for k, c in enumerate(forward, 1))
    return 500_000 + SCALE * a * x, (10_000_000 if south else 0) + SCALE * a * y


def to_degrees(x, y, crs: str) -> tuple[np.ndarray, np.ndarray]:
    """Places in units of a reference system as longitudes and latitudes."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    code = code_of(crs)
    if code in DEGREES:
        return x, y
    if code in MERCATOR:
        return x * (360 / CIRCLE), np.degrees(np.arctan(np.sinh(y / RADIUS)))
    zone, south = _zone(code)
    a, _, back = _series()
    xi, eta = (y - (10_000_000 if south else 0)) / (SCALE * a), (x - 500_000) / (SCALE * a)
    p = xi - sum(c * np.sin(2 * k * xi) * np.cosh(2 * k * eta) for k, c in enumerate(back, 1))
    q = eta - sum(c * np.cos(2 * k * xi) * np.sinh(2 * k * eta) for k, c in enumerate(back, 1))
    t = np.sin(p) / np.hypot(np.sinh(q), np.cos(p))
    e = np.sqrt(FLATTENING * (2 - FLATTENING))
    lat = np.arctan(t)
    for _ in range(4):  # the conformal latitude to the geographic one
        s = np.sin(lat)
        now = np.sinh(np.arctanh(s) - e * np.arctanh(e * s))
        slope = (1 - e * e) / (1 - (e * s) ** 2) * np.sqrt(1 + now * now) * np.sqrt(1 + np.tan(lat) ** 2)
        lat = np.arctan(np.tan(lat) + (np.sin(p) / np.hypot(np.sinh(q), np.cos(p)) - now) / slope * (1 + np.tan(lat) ** 2))
    return zone * 6 - 183 + np.degrees(np.arctan2(np.sinh(q), np.cos(p))), np.degrees(lat)


def box_to_degrees(box: tuple[float, float, float, float], crs: str, steps: int = 21) -> tuple[float, float, float, float]:
    """The box in degrees around a box of a reference system, by points along its sides."""
    t = np.linspace(0, 1, steps)
    w, s, e, n = box
    x = np.concatenate([w + t * (e - w)] * 2 + [np.full(steps, w), np.full(steps, e)])
    y = np.concatenate([np.full(steps, s), np.full(steps, n)] + [s + t * (n - s)] * 2)
    lon, lat = to_degrees(x, y, crs)
    return float(lon.min()), float(lat.min()), float(lon.max()), float(lat.max())
