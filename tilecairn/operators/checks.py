"""Validation and inspection of tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilecairn.functions.cells import resolution
from tilecairn.functions.pixels import decode_udf, is_empty_udf, stretch
from tilecairn.sources import metadata as M
from tilecairn.sources.tables import scan

FINDINGS = "severity string, check string, message string"


def schema_findings(df: DataFrame) -> list[tuple[str, str, str]]:
    """What is wrong with the columns."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    out = []
    if "block" not in kinds:
        out.append("there is no column block")
    elif kinds["block"] not in ("long", "decimal"):
        out.append(f"block is {kinds['block']}, not a 64-bit integer")
    if kinds.get("metadata") != "string":
        out.append("there is no text column metadata")
    bands = M.band_columns(df)
    numbered = [c for c in kinds if c.startswith("band_") and not c.endswith(M.SUFFIXES)]
    if not bands:
        out.append("there is no band")
    out += [f"{c} is {kinds[c]}, not binary" for c in numbered if kinds[c] != "binary"]
    if "pixels" in kinds and numbered:
        out.append("there are both pixels and single bands")
    return [("error", "schema", x) for x in out]


def metadata_findings(text: str | None, rows: int) -> tuple[dict | None, list[tuple[str, str, str]]]:
    """The metadata, as far as it can be read, and what is wrong with it."""
    if not rows:
        return None, [("error", "metadata", "there is no row at block 0")]
    if text is None:
        return None, [("error", "metadata", "the metadata is null")]
    try:
        raw = json.loads(text)
    except ValueError as e:
        return None, [("error", "metadata", f"the metadata is not JSON: {e}")]
    out = []
    if raw.get("version") not in M.VERSIONS:
        out.append(("error", f"unknown version {raw.get('version')}"))
    out += [("error", f"{f} is missing") for f in M.REQUIRED if f not in raw]
    out += [("error", f"tiling.{f} is missing") for f in M.REQUIRED_TILING if "tiling" in raw and f not in raw["tiling"]]
    for i, b in enumerate(raw.get("bands", [])):
        out += [("error", f"band {i} has no {f}") for f in ("name", "type") if f not in b]
        if lacking := [s for s in M.STATISTICS if s not in b]:
            out.append(("warning", f"band {b.get('name', i)} lacks {', '.join(lacking)}"))
    return M.normalized(raw), [(s, "metadata", m) for s, m in out]


def pyramid_report(tiles: DataFrame, least: int, most: int, empty: Column) -> DataFrame:
    """Rows zoom, tiles, valid, share (percent of tiles with a valid pixel) for each zoom of a table."""
    found = tiles.groupBy(resolution(F.col("block")).alias("zoom")).agg(F.count("*").alias("tiles"), F.count_if(~empty).alias("valid"))
    every = tiles.sparkSession.range(least, most + 1).select(F.col("id").cast("int").alias("zoom"))
    joined = every.join(F.broadcast(found), "zoom", "left")  # at most 27 rows
    n, v = (F.coalesce(c, F.lit(0).cast("long")) for c in ("tiles", "valid"))
    return joined.select("zoom", n.alias("tiles"), v.alias("valid"), F.when(n > 0, v / n * 100.0).alias("share"))


def pyramid_findings(report: DataFrame) -> list[tuple[str, str, str]]:
    out = []
    for r in report.collect():  # at most 27 rows
        if not r["tiles"]:
            out.append(("error", f"zoom {r['zoom']} has no tiles"))
        elif not r["valid"]:
            out.append(("error", f"zoom {r['zoom']} has only empty tiles"))
        elif r["share"] < 50:
            out.append(("warning", f"zoom {r['zoom']} has {r['share']:.1f} % tiles with data"))
    return [(s, "pyramid", m) for s, m in sorted(out)]


def sampled(tiles: DataFrame) -> DataFrame:
    """The first, the middle and the last tile by block. The middle is looked for in the range of ids, of at most 8,192,
    that holds it, so no sort spans the table."""
    part = F.shiftrightunsigned(F.col("block"), 44)
    counts = sorted((r["p"], r["n"], r["a"], r["b"]) for r in tiles.groupBy(part.alias("p")).agg(F.count("*").alias("n"), F.min("block").alias("a"), F.max("block").alias("b")).collect())
    if not counts:
        return tiles
    left = (sum(n for _, n, _, _ in counts) - 1) // 2
    for p, n, _, _ in counts:
        if left < n:
            break
        left -= n
    middle = tiles.where(part == p).select("block").orderBy("block").offset(left).limit(1).first()["block"]
    return tiles.where(F.col("block").isin(counts[0][2], middle, counts[-1][3]))


def band_findings(tiles: DataFrame, meta: dict) -> list[tuple[str, str, str]]:
    """Bands in one of table and metadata only, and blobs of the sampled tiles that can't be decoded."""
    inter = meta.get("band_layout") == "interleaved"
    named, there = {b.get("name") for b in meta.get("bands", [])}, set(M.band_columns(tiles))
    want = {"pixels"} if inter else named
    out = [("error", f"{b} is in the metadata, not in the table") for b in sorted(want - there)] + [("warning", f"{b} is in the table, not in the metadata") for b in sorted(there - want)]
    for row in sampled(tiles.select("block", *sorted(there & want))).collect():  # three tiles
        for b in sorted(there & want):
            if row[b] is not None:
                try:
                    stretch(bytes(row[b]), meta.get("compression"))
                except Exception as e:  # a blob can break in any way
                    out.append(("error", f"{b} of block {row['block']}: {e}"))
    return [(s, "bands", m) for s, m in out]


def validate(spark: SparkSession, path: str) -> DataFrame:
    """Rows severity, check, message; a table without an error is valid."""
    df = scan(spark, path)
    found = schema_findings(df)
    if not found:
        rows = df.where("block = 0").select("metadata").limit(1).collect()
        meta, more = metadata_findings(rows[0]["metadata"] if rows else None, len(rows))
        found += more
        if meta and not any(s == "error" for s, _, _ in more):
            tiles = df.where("block <> 0")
            found += band_findings(tiles, meta)
            t, inter = meta["tiling"], meta.get("band_layout") == "interleaved"
            band = meta["bands"][0]
            column = "pixels" if inter else band["name"]
            if column in df.columns and not any(c == "bands" and s == "error" for s, c, _ in found):
                empty = is_empty_udf(band["type"], band.get("nodata"), meta.get("compression"))(column)
                found += pyramid_findings(pyramid_report(tiles.withColumn("_empty", empty), t["min_zoom"], t["max_zoom"], F.col("_empty")))
    return spark.createDataFrame(found, FINDINGS)


def inspect(spark: SparkSession, path: str) -> dict:
    """What a table holds: rows, zooms, bounds, bands and columns."""
    df = scan(spark, path)
    meta = M.parse((df.where("block = 0 and metadata is not null").select("metadata").limit(1).first() or [None])[0])
    counts = df.where("block <> 0").groupBy(resolution(F.col("block")).alias("zoom")).count().orderBy("zoom").collect()
    return {"tiles": sum(r["count"] for r in counts), "zooms": {r["zoom"]: r["count"] for r in counts}, "bounds": meta.get("bounds"), "tiling": meta["tiling"], "bands": meta["bands"], "compression": meta.get("compression"), "columns": df.dtypes}


__all__ = ["band_findings", "decode_udf", "inspect", "metadata_findings", "pyramid_findings", "pyramid_report", "sampled", "schema_findings", "validate"]
