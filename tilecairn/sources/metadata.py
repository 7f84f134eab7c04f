"""The metadata row of a table: one JSON text at block 0."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION, SCHEME = "0.5.0", "cells"
# Versions that are read, fields that must be there, and ends of statistics columns.
VERSIONS = ("0.2.0", "0.3.0", "0.4.0", "0.5.0")
REQUIRED = ("width", "height", "crs", "bounds", "bounds_crs", "tiling", "compression", "bands")
REQUIRED_TILING = ("scheme", "block_width", "block_height", "min_zoom", "max_zoom", "pixel_zoom", "num_blocks")
STATISTICS = ("STATISTICS_MINIMUM", "STATISTICS_MAXIMUM", "STATISTICS_MEAN", "STATISTICS_STDDEV")
SUFFIXES = ("_count", "_min", "_max", "_sum", "_mean", "_stddev")


def plain_nodata(value):
    """A nodata value as JSON has it: special floats by name, whole floats as integers."""
    if value is None or isinstance(value, str):
        return value
    if math.isnan(value):
        return "NaN"
    if math.isinf(value):
        return "Infinity" if value > 0 else "-Infinity"
    return int(value) if float(value).is_integer() else float(value)


def _finite(v):
    return None if v is None or not math.isfinite(v) else v


@dataclass
class Band:
    name: str
    type: str
    nodata: float | str | None = None
    description: str | None = None
    unit: str | None = None
    scale: float | None = None
    offset: float | None = None
    colorinterp: str | None = None
    colortable: dict | None = None
    statistics: dict = field(default_factory=dict)

    def document(self) -> dict:
        s = self.statistics
        named = {"MINIMUM": "min", "MAXIMUM": "max", "MEAN": "mean", "STDDEV": "stddev", "VALID_PERCENT": "valid_percent"}
        out = {"name": self.name, "description": self.description, "type": self.type, "nodata": plain_nodata(self.nodata), "unit": self.unit, "scale": self.scale, "offset": self.offset, "colorinterp": self.colorinterp}
        if self.colortable is not None:
            out["colortable"] = self.colortable
        out |= {f"STATISTICS_{k}": _finite(s[v]) for k, v in named.items() if v in s}
        return out | ({"histogram": s["histogram"]} if "histogram" in s else {})


def document(bands: list[Band], bounds: list[float], width: int, height: int, least_zoom: int, most_zoom: int, block_size: int, blocks: int, compression: str | None = "gzip", layout: str = "sequential", quality: int | None = None, tile_statistics: bool = False, time: dict | None = None, file_format: str = "tiles", **more) -> dict:
    """The metadata of a table as a dictionary. ``more`` holds further root fields, such as processing or custom."""
    tiling = {"scheme": SCHEME, "block_width": block_size, "block_height": block_size, "min_zoom": least_zoom, "max_zoom": most_zoom, "pixel_zoom": most_zoom + int(math.log2(block_size)), "num_blocks": blocks}
    out = {"file_format": file_format, "version": VERSION, "width": width, "height": height, "crs": "EPSG:3857", "bounds": bounds, "bounds_crs": "EPSG:4326", "tiling": tiling, "compression": None if compression == "none" else compression, "bands": [b.document() for b in bands]}
    if layout == "interleaved":
        out["band_layout"] = layout
    if quality is not None and compression in ("jpeg", "webp"):
        out["compression_quality"] = quality
    if tile_statistics:
        out |= {"tile_statistics": True, "tile_statistics_columns": [s[1:] for s in SUFFIXES]}
    if time:
        out["time"] = time
    return out | more


def normalized(meta: dict) -> dict:
    """Metadata of older versions in the present form: flat keys move to tiling."""
    if "tiling" in meta:
        return meta
    old = {"block_width": "block_width", "block_height": "block_height", "min_zoom": "minresolution", "max_zoom": "maxresolution", "num_blocks": "num_blocks"}
    tiling = {"scheme": SCHEME} | {new: meta.get(key) for new, key in old.items()}
    if tiling["max_zoom"] is not None and tiling["block_width"]:
        tiling["pixel_zoom"] = meta.get("pixresolution", tiling["max_zoom"] + int(math.log2(tiling["block_width"])))
    bands = [b | ({"nodata": meta["nodata"]} if "nodata" in meta and "nodata" not in b else {}) for b in meta.get("bands", [])]
    return {k: v for k, v in meta.items() if k not in old.values()} | {"tiling": tiling, "bands": bands, "bounds_crs": meta.get("bounds_crs", "EPSG:4326"), "crs": meta.get("crs", "EPSG:3857"), "compression": meta.get("compression")}


def metadata_row(df: DataFrame, meta: dict) -> DataFrame:
    """The metadata as one row with the columns of df, all others null."""
    spark = df.sparkSession
    one = spark.range(1).select(F.lit(0).cast("long").alias("block"), F.lit(json.dumps(meta)).alias("metadata"))
    return one.select("block", "metadata", *(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema if f.name not in ("block", "metadata")))


def parse(text: str | None) -> dict:
    if text is None:
        raise ValueError("the table has no metadata")
    return normalized(json.loads(text))


def band_type(meta: dict, band: str) -> dict:
    """The entry of a band."""
    found = next((b for b in meta["bands"] if b["name"] == band), None)
    if found is None:
        raise ValueError(f"no band {band}; there are {', '.join(b['name'] for b in meta['bands'])}")
    return found


def band_columns(df: DataFrame) -> list[str]:
    """Binary columns, without stored statistics."""
    return [f.name for f in df.schema if f.dataType.typeName() == "binary" and not f.name.endswith(SUFFIXES)]


def looks_like_tiles(df: DataFrame) -> bool:
    """Whether the columns are those of a table of tiles: an integer block, text metadata, a binary column."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    return kinds.get("block") in ("long", "decimal") and kinds.get("metadata") == "string" and bool(band_columns(df))


def time_axis(df: DataFrame, units: str, calendar: str = "standard") -> dict:
    """The time entry of the metadata from the distinct steps of a table: units, calendar, number, first and last, and
    the resolution as an ISO 8601 duration where the steps are regular."""
    from tilecairn.functions.cftime import axis_interval, iso_duration, parse_units

    steps = df.select("time_cf").distinct()
    row = steps.agg(F.min("time_cf").alias("a"), F.max("time_cf").alias("b"), F.count("*").alias("n")).first()
    even = axis_interval(steps.withColumn("_axis", F.lit(0)), ["_axis"], "time_cf")
    named = even.select(F.when(F.col("regular"), iso_duration(parse_units(F.lit(units))["unit"], F.col("interval"))).alias("d")).first()
    return {"cf:units": units, "cf:calendar": calendar, "resolution": named and named["d"], "count": row["n"], "range": [row["a"], row["b"]]}
