"""Rasters that a remote service exports, and listings of terrain files: the requests, the waiting and the paging.

The service itself, and what proves who asks, are objects of the caller; none comes with this package, and
an expression is given to the service as text and never evaluated here.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilecairn.functions.mercator import CIRCLE
from tilecairn.operators.ingest import convert_raster
from tilecairn.sources.services import ExportJob, fetch, request

LISTED = "name string, url string, bytes long, date string, west double, south double, east double, north double"


class Exporter(Protocol):
    """What a remote service has to offer: a session, an image, a task, its state, and its files."""

    def sign_in(self, credentials: str | None) -> None: ...

    def image(self, asset: str | None, expression: str | None, bands: list[str] | None) -> object: ...

    def start(self, asset: object, transform: list[float]) -> object: ...

    def state(self, job: object) -> dict: ...

    def delete(self, path: str) -> None: ...


def export_transform(zoom: int, block_zoom: int = 8) -> list[float]:
    """The transform that aligns an export with the tiles of a zoom: pixel size and top left corner in metres."""
    unit = CIRCLE / (1 << block_zoom) / (1 << zoom)
    return [unit, 0.0, -CIRCLE / 2, 0.0, -unit, CIRCLE / 2]


def parse_asset(text: str) -> tuple[str | None, str | None]:
    """An asset's name, or after "expr:" an expression for the service."""
    if text.startswith("expr:"):
        if not text[5:].strip():
            raise ValueError("the expression is empty")
        return None, text[5:].strip()
    if not re.fullmatch(r"[\w./:-]+", text):
        raise ValueError(f"not the name of an asset: {text}")
    return text, None


def convert_export(spark: SparkSession, service: Exporter, asset: str, table: str, zoom: int, bands: list[str] | None = None, credentials: str | None = None, keep: bool = False, most_s: float = 3600.0, every_s: float = 10.0, sleep: Callable = time.sleep, convert: Callable = convert_raster, **options) -> dict:
    """Let a service export an asset or expression on the grid of a zoom, wait for it, write it as a table, and delete
    what the service wrote unless ``keep``, also after an error. Gives the metadata."""
    name, expression = parse_asset(asset)
    service.sign_in(credentials)
    job = ExportJob(service, service.image(name, expression, bands), export_transform(zoom))
    path = job.wait(most_s, every_s, sleep)
    try:
        return convert(spark, path, table, zoom=zoom, **options)
    finally:
        if not keep:
            service.delete(path)


@dataclass(frozen=True)
class Page:
    """Entries of a listing and what leads to the next page."""

    rows: list[tuple]
    after: object | None


def elevation_page(url: str, box: tuple[float, float, float, float], after: int | None = None, size: int = 100, product: str | None = None, get: Callable = fetch) -> Page:
    """A page of a listing of terrain files by an offset: JSON with items and a total."""
    given = {"bbox": ",".join(map(str, box)), "max": size, "offset": after or 0, "outputFormat": "JSON"} | ({"datasets": product} if product else {})
    raw = json.loads(request(url, given, get=get))
    rows = []
    for i in raw.get("items", []):
        b = i.get("boundingBox") or {}
        place = (None if b.get(k) is None else float(b[k]) for k in ("minX", "minY", "maxX", "maxY"))
        rows.append((i.get("title"), i.get("downloadURL"), i.get("sizeInBytes"), i.get("publicationDate"), *place))
    seen = (after or 0) + len(rows)
    return Page(rows, seen if rows and seen < raw.get("total", 0) else None)


def bucket_page(url: str, prefix: str, after: str | None = None, size: int = 1000, suffix: str = ".tif", get: Callable = fetch) -> Page:
    """A page of a listing of a bucket by a token: XML with keys, sizes and dates."""
    raw = request(url, {"list-type": 2, "prefix": prefix, "max-keys": size} | ({"continuation-token": after} if after else {}), get=get)
    root = ElementTree.fromstring(raw)
    text = lambda node, name: next((c.text for c in node.iter() if c.tag.rsplit("}", 1)[-1] == name), None)
    rows = []
    for node in (n for n in root.iter() if n.tag.rsplit("}", 1)[-1] == "Contents"):
        key = text(node, "Key") or ""
        if key.endswith(suffix):
            rows.append((key.rsplit("/", 1)[-1], f"{url.rstrip('/')}/{key}", int(text(node, "Size") or 0), (text(node, "LastModified") or "")[:10], *_box_of(key)))
    return Page(rows, text(root, "NextContinuationToken") if text(root, "IsTruncated") == "true" else None)


def _box_of(key: str) -> tuple[float | None, ...]:
    """The degree that a file's name tells by its north west corner, as in n41w106."""
    m = re.search(r"([ns])(\d{2})([ew])(\d{3})", key.lower())
    if not m:
        return (None,) * 4
    north, west = int(m[2]) * (1 if m[1] == "n" else -1), int(m[4]) * (1 if m[3] == "e" else -1)
    return float(west), float(north - 1), float(west + 1), float(north)


def pages(first: Callable[[object | None], Page]) -> Iterator[Page]:
    """All pages of a listing; a page that leads to itself ends it."""
    after = None
    while True:
        page = first(after)
        yield page
        if page.after is None or page.after == after:
            return
        after = page.after


def listing(spark: SparkSession, page: Callable[[object | None], Page]) -> DataFrame:
    """A listing as rows (LISTED), all pages of it."""
    return spark.createDataFrame([r for p in pages(page) for r in p.rows], LISTED)


def in_box(files: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """The files whose box meets a box; those that tell none stay."""
    w, s, e, n = box
    return files.where(F.coalesce((F.col("west") < e) & (F.col("east") > w) & (F.col("south") < n) & (F.col("north") > s), F.lit(True)))
