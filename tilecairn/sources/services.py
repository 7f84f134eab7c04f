"""Image services over HTTP as a source of tiles; the request function can be replaced, as tests do."""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilecairn.functions.cells import checked_block_size, tile_to_cell
from tilecairn.functions.mercator import CIRCLE, tile_at
from tilecairn.functions.pixels import SERVICE_TYPES, encode, fitted, nodata_value, valid
from tilecairn.functions.projections import box_to_degrees, from_degrees
from tilecairn.plans.scratch import cut
from tilecairn.sources.grids import read_tiff

FATAL = {401: "a token is needed", 403: "access is denied", 404: "there is no such service"}


def fetch(url: str, parameters: dict, timeout: float = 60.0) -> tuple[int, dict, bytes]:
    """Status, headers and body of a GET request."""
    try:
        with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(parameters)}", timeout=timeout) as r:
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read()


def request(url: str, parameters: dict, retries: int = 3, delay: float = 1.0, get: Callable = fetch, sleep: Callable = time.sleep) -> bytes:
    """The body, after retries of failed connections, 429 and server errors: with a delay that grows by the attempt,
    or as long as the service asks for. Refusals and other client errors raise at once."""
    for attempt in range(1, retries + 2):
        wait, reason = delay * attempt, ""
        try:
            status, headers, body = get(url, parameters)
        except OSError as e:
            reason = str(e)
        else:
            if status < 400:
                return body
            if status in FATAL:
                raise PermissionError(f"{url}: {FATAL[status]}") if status != 404 else FileNotFoundError(f"{url}: {FATAL[status]}")
            if status != 429 and status < 500:
                raise ValueError(f"{url}: status {status}")
            reason = f"status {status}"
            if str(headers.get("Retry-After", "")).isdigit():
                wait = float(headers["Retry-After"])
        if attempt <= retries:
            sleep(wait)
    raise ConnectionError(f"{url}: {reason} after {retries + 1} attempts")


def service_metadata(url: str, token: str | None = None, get: Callable = fetch) -> dict:
    """extent, pixel type, bands, nodata and pixel size of a service."""
    raw = json.loads(request(url, {"f": "json"} | ({"token": token} if token else {}), get=get))
    if "error" in raw:
        raise ValueError(raw["error"].get("message", "the service reports an error"))
    return {"extent": raw["extent"], "type": SERVICE_TYPES.get(raw.get("pixelType", ""), "float32"), "bands": raw.get("bandCount", 1), "nodata": raw.get("noDataValue"), "pixel": raw.get("pixelSizeX"), "columns": raw.get("columns"), "name": raw.get("name")}


def tile_request(url: str, x: int, y: int, z: int, size: int, token: str | None = None, bands: list[int] | None = None) -> dict:
    """The parameters that ask a service for a tile, by nearest neighbour."""
    unit, edge = CIRCLE / (1 << z), CIRCLE / 2
    box = (x * unit - edge, edge - (y + 1) * unit, (x + 1) * unit - edge, edge - y * unit)
    out = {"f": "image", "format": "tiff", "bbox": ",".join(map(repr, box)), "bboxSR": 3857, "imageSR": 3857, "size": f"{size},{size}", "interpolation": "RSP_NearestNeighbor"}
    return out | ({"bandIds": ",".join(map(str, bands))} if bands else {}) | ({"token": token} if token else {})


def intersected(box: tuple, extent: tuple) -> tuple:
    """The part of a box within an extent; raises where there is none."""
    w, s, e, n = max(box[0], extent[0]), max(box[1], extent[1]), min(box[2], extent[2]), min(box[3], extent[3])
    if w >= e or s >= n:
        raise ValueError("the box lies outside the service's extent")
    return w, s, e, n


def _tiles(batches, url: str, size: int, kind: str, bands: int, nodata, token: str | None, skip_empty: bool, get: Callable) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x, y, z, block in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            values, _ = read_tiff(request(url + "/exportImage", tile_request(url, x, y, z, size, token), get=get))
            cut = [fitted(values[..., i], size, nodata) for i in range(bands)]
            if skip_empty and not any(valid(c, nodata).any() for c in cut):
                continue
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([encode(c, kind)], pa.binary()) for c in cut)], ["block", *(f"band_{i + 1}" for i in range(bands))])


def service_tiles(spark: SparkSession, url: str, tiles: DataFrame, size: int = 256, token: str | None = None, skip_empty: bool = True, get: Callable = fetch) -> DataFrame:
    """block and bands of the tiles (x, y, z, block) that a service gives: one request a tile, by the tasks."""
    checked_block_size(size)
    info = service_metadata(url, token, get)
    schema = ", ".join(["block long", *(f"band_{i + 1} binary" for i in range(info["bands"]))])
    return tiles.select("x", "y", "z", "block").mapInArrow(partial(_tiles, url=url, size=size, kind=info["type"], bands=info["bands"], nodata=info["nodata"], token=token, skip_empty=skip_empty, get=get), schema)


def reference_system(spatial: dict | None) -> str:
    """The reference system that a service names: known ids of Web Mercator, other ids as EPSG codes, else degrees."""
    spatial = spatial or {}
    wkid = spatial.get("latestWkid") or spatial.get("wkid")
    return {102100: "EPSG:3857", 102113: "EPSG:3785", None: spatial.get("wkt") or "EPSG:4326"}.get(wkid, f"EPSG:{wkid}")


def service_plan(info: dict, size: int, box: tuple | None = None, box_crs: str = "EPSG:4326", zoom: int | None = None) -> tuple[int, tuple[float, float, float, float]]:
    """The zoom, and the box in degrees, to ask a service for: its extent or the part of it within a box in any known
    system. The zoom is the least whose pixels are as fine as the service's, 22 at most."""
    e = info["extent"]
    crs = reference_system(e.get("spatialReference"))
    extent = box_to_degrees((e["xmin"], e["ymin"], e["xmax"], e["ymax"]), crs)
    wanted = intersected(box_to_degrees(box, box_crs), extent) if box else extent
    (left, right), _ = from_degrees(np.array([extent[0], extent[2]]), np.zeros(2), "EPSG:3857")
    columns = info.get("columns") or (abs(e["xmax"] - e["xmin"]) / info["pixel"] if info.get("pixel") else 256)
    block_zoom = int(math.log2(size))
    if zoom is None:
        zoom = math.ceil(math.log2(CIRCLE / size / (abs(right - left) / columns)) - 1e-9)
    return max(0, min(26 - block_zoom, 22, zoom)), wanted


def tiles_of_box(spark: SparkSession, box: tuple, zoom: int) -> DataFrame:
    """Rows x, y, z, block: the tiles at a zoom that a box in degrees meets, made row by row by the tasks."""
    w, s, e, n = box
    nudge = 1e-9  # what lies on a border of tiles meets but one of them
    (x0, y0), (x1, y1) = tile_at(w + nudge, n - nudge, zoom), tile_at(e - nudge, s + nudge, zoom)
    across = F.sequence(F.lit(x0).cast("long"), F.lit(max(x0, x1)).cast("long"))
    rows = spark.range(y0, max(y0, y1) + 1).select(F.explode(across).alias("x"), F.col("id").alias("y"), F.lit(zoom).alias("z"))
    return rows.withColumn("block", tile_to_cell(F.col("x"), F.col("y"), zoom))


def convert_service(spark: SparkSession, url: str, table: str, box: tuple | None = None, box_crs: str = "EPSG:4326", size: int = 256, zoom: int | None = None, token: str | None = None, skip_empty: bool = True, statistics: bool = True, compression: str | None = "gzip", group_rows: int = 200, get: Callable = fetch) -> dict:
    """Write what an image service holds in a box as a table of one zoom with statistics and metadata; gives a summary:
    blocks, bands, zoom, type, bounds and bytes."""
    from tilecairn.operators.convert import Overviews, build_table
    from tilecairn.sources.tables import scan

    info = service_metadata(url, token, get)
    zoom, wanted = service_plan(info, size, box, box_crs, zoom)
    asked = tiles_of_box(spark, wanted, zoom)
    native = service_tiles(spark, url, asked.repartition(max(1, spark.sparkContext.defaultParallelism)), size, token, skip_empty, get)
    meta = build_table(spark, cut(native), table, info["type"], zoom, size, zoom, Overviews.NONE, compression=compression, tile_statistics=statistics, nodata=nodata_value(info["nodata"]), group_rows=group_rows, keep_empty=not skip_empty, source={"url": url, "name": info.get("name")})
    size_ = scan(spark, table).where("block <> 0").agg(F.sum(sum((F.octet_length(f"band_{i + 1}") for i in range(info["bands"])), F.lit(0)))).first()[0]
    return {"blocks": meta["tiling"]["num_blocks"], "asked": asked.count(), "bands": info["bands"], "zoom": zoom, "type": info["type"], "bounds": meta["bounds"], "bytes": size_ or 0}


class ExportJob:
    """An export by a remote service that is started, watched and read when done. The service is an object with
    start(asset, transform), state(job) and delete(path); none comes with this package."""

    def __init__(self, service, asset: str, transform: list[float]):
        self.service, self.job = service, service.start(asset, transform)

    def wait(self, most_s: float = 3600.0, every_s: float = 10.0, sleep: Callable = time.sleep) -> str:
        """The path of the result; raises where the job fails or takes too long."""
        passed = 0.0
        while passed <= most_s:
            state = self.service.state(self.job)
            if state["state"] == "COMPLETED":
                return state["path"]
            if state["state"] in ("FAILED", "CANCELLED"):
                raise RuntimeError(state.get("error", state["state"]))
            sleep(every_s)
            passed += every_s
        raise TimeoutError(f"no result after {most_s} s")
