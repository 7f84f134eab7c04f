"""Command line: inspect, validate, split by zoom, partition, convert raster files and services, export, query."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import SparkSession

from tilecairn.operators.convert import Codec, Layout, Overviews, ZoomStrategy
from tilecairn.operators.pyramid import KERNELS, REDUCERS



def _common(c: argparse.ArgumentParser) -> None:
    c.add_argument("--block-size", type=int, default=256, help="pixels of a tile's side, a power of two from 16 on")
    c.add_argument("--compression", choices=[*Codec], default="gzip")
    c.add_argument("--tile-stats", action="store_true", help="store each tile's statistics as columns")
    c.add_argument("--group-rows", "--row-group-size", type=int, default=200)
    c.add_argument("--verbose", "-v", action="store_true")


def _raster_options(c: argparse.ArgumentParser) -> None:
    _common(c)
    c.add_argument("--zoom", type=int, help="the finest zoom; by default that of the file's resolution")
    c.add_argument("--zoom-strategy", choices=[*ZoomStrategy], default="auto")
    c.add_argument("--resampling", choices=sorted([*REDUCERS, *KERNELS]), default="near")
    c.add_argument("--overviews", choices=[*Overviews], default="auto")
    c.add_argument("--min-zoom", type=int)
    c.add_argument("--band-layout", choices=[*Layout], default="sequential")
    c.add_argument("--compression-quality", type=int, default=85)
    c.add_argument("--target-file-bytes", "--target-size", type=int, default=0)
    c.add_argument("--no-assume-lonlat", action="store_true", help="refuse files without a reference system")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tilecairn", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("inspect", "validate"):
        c = sub.add_parser(name)
        c.add_argument("table")
        c.add_argument("--json", action="store_true")
        c.add_argument("--verbose", "-v", action="store_true")
    c = sub.add_parser("split-zoom")
    c.add_argument("table")
    c.add_argument("to")
    c.add_argument("--group-rows", "--row-group-size", type=int, default=200)
    c = sub.add_parser("partition")
    c.add_argument("table")
    c.add_argument("to")
    c.add_argument("--zoom", "--partition-zoom", type=int)
    c.add_argument("--target-mb", "--target-size", type=int, default=128)
    c.add_argument("--group-rows", "--row-group-size", type=int, default=200)
    kinds = sub.add_parser("convert").add_subparsers(dest="kind", required=True)
    for name in ("raster", "geotiff"):
        c = kinds.add_parser(name)
        c.add_argument("file")
        c.add_argument("table")
        _raster_options(c)
    c = kinds.add_parser("imageserver")
    c.add_argument("url")
    c.add_argument("table")
    _common(c)
    c.add_argument("--token")
    c.add_argument("--bbox", help="west,south,east,north")
    c.add_argument("--bbox-crs", default="EPSG:4326")
    c.add_argument("--zoom", "--resolution", type=int)
    c.add_argument("--no-skip-empty", action="store_true")
    c = kinds.add_parser("remote", aliases=["earthengine"])
    c.add_argument("asset", help="the name of an asset, or expr: and an expression for the service")
    c.add_argument("table")
    _raster_options(c)
    c.add_argument("--service", required=True, help="module:name of a function that gives the exporter")
    c.add_argument("--credentials")
    c.add_argument("--band", action="append", dest="bands")
    c.add_argument("--keep", action="store_true", help="leave what the service wrote")
    c.add_argument("--timeout", type=float, default=3600.0)
    c.add_argument("--poll-seconds", type=float, default=10.0)
    kinds = sub.add_parser("export").add_subparsers(dest="kind", required=True)
    c = kinds.add_parser("geotiff")
    c.add_argument("table")
    c.add_argument("file")
    c.add_argument("--no-overviews", action="store_true")
    c = sub.add_parser("sql")
    c.add_argument("text")
    return p


def _with_kind(argv: list[str]) -> list[str]:
    """The kind may be left out: ``convert FILE TABLE`` is of a raster, ``export TABLE FILE`` to a TIFF."""
    kinds = {"convert": ("raster", ["raster", "geotiff", "imageserver", "remote", "earthengine"]), "export": ("geotiff", ["geotiff"])}
    if argv[:1] and argv[0] in kinds and len(argv) > 1 and argv[1] not in (*kinds[argv[0]][1], "-h", "--help"):
        return [argv[0], kinds[argv[0]][0], *argv[1:]]
    return argv


def _file_options(a: argparse.Namespace) -> dict:
    return {"zoom_strategy": a.zoom_strategy, "resampling": a.resampling, "block_size": a.block_size, "least_zoom": a.min_zoom, "overviews": a.overviews, "layout": a.band_layout, "compression": a.compression, "quality": a.compression_quality, "tile_statistics": a.tile_stats, "group_rows": a.group_rows, "file_bytes": a.target_file_bytes, "assume_lonlat": not a.no_assume_lonlat}


def _convert(a: argparse.Namespace, spark: SparkSession) -> None:
    from tilecairn.operators.ingest import convert_raster
    from tilecairn.sources.remote import convert_export
    from tilecairn.sources.services import convert_service

    if a.kind in ("raster", "geotiff"):
        found = convert_raster(spark, a.file, a.table, zoom=a.zoom, **_file_options(a))
    elif a.kind == "imageserver":
        box = tuple(float(v) for v in a.bbox.split(",")) if a.bbox else None
        found = convert_service(spark, a.url, a.table, box, a.bbox_crs, a.block_size, a.zoom, a.token, not a.no_skip_empty, a.tile_stats, a.compression, a.group_rows)
    else:
        module, name = a.service.split(":")
        service = getattr(importlib.import_module(module), name)()
        if a.zoom is None:
            raise SystemExit("an export needs --zoom")
        found = convert_export(spark, service, a.asset, a.table, a.zoom, a.bands, a.credentials, a.keep, a.timeout, a.poll_seconds, **_file_options(a))
    print(json.dumps(found, default=str) if a.verbose else json.dumps({k: found[k] for k in ("bounds", "blocks", "width", "height", "zoom") if k in found}))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(_with_kind(list(sys.argv[1:] if argv is None else argv)))
    from tilecairn.session import make_importable

    spark = spark or SparkSession.builder.appName("tilecairn").getOrCreate()
    make_importable(spark)
    if a.command == "inspect":
        from tilecairn.operators.checks import inspect

        found = inspect(spark, a.table)
        print(json.dumps(found, default=str, indent=None if a.json else 2))
    elif a.command == "validate":
        from tilecairn.operators.checks import validate

        rows = [r.asDict() for r in validate(spark, a.table).collect()]
        print(json.dumps({"valid": not any(r["severity"] == "error" for r in rows), "findings": rows}) if a.json else "\n".join(f"{r['severity']}: {r['check']}: {r['message']}" for r in rows) or "valid")
        return int(any(r["severity"] == "error" for r in rows))
    elif a.command == "split-zoom":
        from tilecairn.operators.layout import split_by_zoom

        split_by_zoom(spark, a.table, a.to, a.group_rows)
    elif a.command == "partition":
        from tilecairn.operators.layout import partition

        print(partition(spark, a.table, a.to, a.zoom, a.target_mb << 20, a.group_rows))
    elif a.command == "convert":
        _convert(a, spark)
    elif a.command == "export":
        from tilecairn.operators.export import export_table

        print(json.dumps(export_table(spark, a.table, a.file, not a.no_overviews)))
    elif a.command == "sql":
        from tilecairn.sql import query

        query(spark, a.text).show(truncate=False)
    return 0


def convert_main() -> int:
    """Console script: convert a raster file."""
    return main(["convert", "raster", *sys.argv[1:]])


def export_main() -> int:
    """Console script: export a table as a TIFF file."""
    return main(["export", "geotiff", *sys.argv[1:]])


if __name__ == "__main__":
    sys.exit(main())
