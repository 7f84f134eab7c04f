"""Cells, tiles, pixels, tables: vectors, round trips, pruning, and brute force."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilecairn import fixtures as fx
from tilecairn.functions import cells, cftime, pixels
from tilecairn.functions import mercator as merc
from tilecairn.functions.geometry import Area, box_area, cover, parse_point, parse_wkt, pixel_mask
from tilecairn.functions.stats import summary, summary_udf
from tilecairn.operators import checks, convert, export, layout, pyramid, zonal
from tilecairn.plans.ranges import in_cover, in_zoom
from tilecairn.sources import grids, metadata, services, tables

D = "/root/testdata/sf0.001"


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_cell_vectors():
    assert cells.cell_of(0, 0, 0) == 5192650370358181887
    assert cells.cell_of(1, 2, 3) == 5202361257054699519
    assert cells.cell_of(9, 8, 4) == 5209574053332910079
    assert cells.checked_block_size(256) == 256
    for bad in (8, 100, 0):
        with pytest.raises(ValueError):
            cells.checked_block_size(bad)


def test_cells_as_columns(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(0, 1 << z)), int(rng.integers(0, 1 << z)), z, int(rng.integers(0, z + 1))) for z in range(27) for _ in range(8)]
    df = spark.createDataFrame(rows, "x long, y long, z int, p int").withColumn("c", cells.tile_to_cell(F.col("x"), F.col("y"), F.col("z")))
    lo, hi = cells.descendants(cells.parent(F.col("c"), F.col("p")), F.col("z"))
    df = df.select("*", cells.cell_to_tile(F.col("c")).alias("t"), cells.parent(F.col("c"), F.col("p")).alias("up"), F.col("c").between(lo, hi).alias("within"), cells.is_cell(F.col("c")).alias("ok"))
    for r in df.collect():
        assert r.c == cells.cell_of(r.x, r.y, r.z) and (r.t.x, r.t.y, r.t.z) == (r.x, r.y, r.z) == cells.tile_of(r.c)
        assert r.up == cells.cell_of(r.x >> r.z - r.p, r.y >> r.z - r.p, r.p) and r.within and r.ok
    assert not one(spark, cells.is_cell(F.lit(5270498377487261695)))[0]


def test_mercator_vectors(spark):
    r = one(spark, merc.least_zoom(F.lit(256.0), F.lit(256.0), F.lit(8)), merc.export_transform(5), merc.tile_x(F.lit(180.0), 3), merc.tile_y(F.lit(-90.0), 3), merc.tile_y(F.lit(89.0), 3))
    assert r[0] == 8 - round(math.log2(math.hypot(256, 256) / 128))
    assert r[1][0] == pytest.approx(4891.96981025) and r[2] == 7 and r[3] == 7 and r[4] == 0
    b = one(spark, merc.bounds(F.lit(16), F.lit(8), 5), merc.bounds(F.lit(19), F.lit(11), 5), merc.metre_bounds(F.lit(16), F.lit(8), 5))
    assert (b[0].west, b[1].east) == (0, 45) and b[0].north == pytest.approx(66.513, abs=1e-3) and b[1].south == pytest.approx(40.98, abs=1e-2)
    assert b[2].top == pytest.approx(10018754.17139462)
    x = one(spark, F.size(merc.bbox_tiles(F.lit(0.0), F.lit(0.0), F.lit(45.0), F.lit(40.0), 3)), F.size(merc.bbox_tiles(F.lit(170.0), F.lit(-10.0), F.lit(-170.0), F.lit(10.0), 3)))
    assert tuple(x) == (1, 4)


def test_statistics_vectors():
    v = np.arange(100)
    for values in (v, np.append(v.astype("f8"), np.nan)):
        s = summary(values, 0)
        assert (s["count"], s["min"], s["max"], s["mean"], s["sum"], s["sum_squares"]) == (99, 1, 99, 50, 4950, 328350)
        assert s["stddev"] == pytest.approx(28.577380332)
    wild = np.append(np.linspace(0, 1, 200), 1e9)
    assert summary(wild, outliers=True)["max"] == 1 and summary(wild)["max"] == 1e9 and summary(np.array([np.nan])) is None


@pytest.mark.parametrize("kind", list(pixels.TYPES))
def test_codec_round_trip(kind):
    v = np.arange(256).astype(pixels.TYPES[kind]) if kind != "int8" else np.arange(-128, 128).astype("i1")
    for c in ("gzip", "none"):
        assert (pixels.decode(pixels.encode(v, kind, c), kind, c) == v).all()
    assert (pixels.decode_bands(pixels.encode_bands([v, v[::-1]], kind), kind, 2) == [v, v[::-1]]).all()
    with pytest.raises(ValueError):
        pixels.encode(v, kind, "webp")


def test_nodata_and_padding():
    v = np.array([1, 2, np.nan, -9999], "f4")
    assert pixels.valid(v, -9999).tolist() == [True, True, False, False] and pixels.valid(v, "NaN").tolist() == [True, True, False, True]
    assert pixels.fitted(np.ones((3, 5)), 4, -1).tolist() == [[1, 1, 1, 1]] * 3 + [[-1] * 4]


STAR = Area(((((-100.0, -50.0), (100.0, -50.0), (0.0, 70.0), (-20.0, -10.0)), ((0.0, -20.0), (20.0, -20.0), (10.0, 5.0))),))


@pytest.mark.parametrize("mode", ["intersects", "center", "contains"])
def test_cover_against_all_tiles(mode):
    z, size = 5, 16
    found = cover(STAR, z, mode)
    ids = {cells.cell_of(x, y, z) for x in range(32) for y in range(32)}
    inside = {c for c in ids if any(a <= c <= b for a, b, _ in found.ranges)}
    for c in ids:
        x, y, _ = cells.tile_of(c)
        mask = pixel_mask(STAR, x, y, z, size)
        if mode == "intersects" and mask.any() or mode == "contains" and c in inside:
            assert c in inside and (mode != "contains" or mask.all())
        if mode == "intersects" and any(a <= c <= b and whole for a, b, whole in found.ranges):
            assert mask.all()
    assert inside and len(found.merged(3)) <= 3 and all(any(a <= c <= b for a, b in found.merged(3)) for c in inside)


def test_cover_as_predicate(spark):
    z = 6
    found = cover(STAR, z)
    rows = [(cells.cell_of(x, y, z),) for x in range(64) for y in range(64)]
    df = spark.createDataFrame(rows, "block long")
    got = {r.block for r in df.where(in_cover(F.col("block"), found, 4)).collect()}
    assert got == {c for (c,) in rows if any(a <= c <= b for a, b, _ in found.ranges)}


def test_well_known_text():
    assert parse_wkt("MULTIPOLYGON(((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6), (5.2 5.1, 5.3 5.1, 5.3 5.2)))").box == (0, 0, 6, 6)
    assert parse_point("POINT (1.5 -2e1)") == (1.5, -20)
    for bad in ("LINESTRING(0 0, 1 1)", "POLYGON((0 0, 1 1))", "POLYGON(())"):
        with pytest.raises(ValueError):
            parse_wkt(bad)


def test_points_get_values(spark):
    tiles = fx.float_tiles(spark, D)
    raw = {r.block: pixels.decode(bytes(r.band_1), "float32") for r in tiles.collect()}
    block = sorted(raw)[3]
    x, y, z = cells.tile_of(block)
    w, s, e, n = merc.tile_box(x, y, z)
    pts = spark.createDataFrame([(1, w + (e - w) * 0.4, (s + n) / 2), (2, w + (e - w) * 0.4, (s + n) / 2), (3, None, 0.0), (4, 0.0, 89.9)], "id int, lon double, lat double")
    out = {r.id: r.value for r in zonal.values_at(pts, tiles, "band_1", "float32", z, 16).collect()}
    assert out[1] == out[2] and out[1] in raw[block][7 * 16 + 6 : 7 * 16 + 7].tolist() + raw[block][8 * 16 + 6 : 8 * 16 + 7].tolist() and out[3] is None


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "table")
    native = fx.float_tiles(spark, D, -9999.0).drop("t")
    return path, convert.build_table(spark, native, path, "float32", fx.ZOOM, 16, least_zoom=4, nodata=-9999.0, group_rows=10)


def test_written_table(spark, table):
    path, meta = table
    assert metadata.looks_like_tiles(tables.scan(spark, path)) and tables.read_metadata(spark, path) == meta
    assert not [r for r in checks.validate(spark, path).collect() if r.severity == "error"]
    native = fx.float_tiles(spark, D, -9999.0)
    got = {r.block: bytes(r.band_1) for r in tables.read_table(spark, path, ["band_1"], fx.ZOOM).collect()}
    assert got == {r.block: bytes(r.band_1) for r in native.collect()}
    whole = np.concatenate([pixels.decode(b, "float32") for b in got.values()])
    band = meta["bands"][0]
    assert band["STATISTICS_MEAN"] == pytest.approx(whole[whole >= 0].mean(), rel=1e-5) and band["STATISTICS_STDDEV"] == pytest.approx(whole[whole >= 0].astype("f8").std())
    assert checks.inspect(spark, path)["zooms"].keys() == set(range(4, 9))


def scanned(df) -> int:
    """Rows that the file scans of an executed plan gave."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if "FileSourceScan" in p.getClass().getSimpleName():
            total += p.metrics().get("numOutputRows").get().value()
        todo += [p.children().apply(i) for i in range(p.children().size())]
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        if "QueryStage" in p.getClass().getSimpleName():
            todo.append(p.plan())
    return total


def test_point_and_region_reads_prune(spark, table):
    path, _ = table
    every = tables.read_table(spark, path).count()
    block = tables.read_table(spark, path, zoom=fx.ZOOM).agg(F.max("block")).first()[0]
    x, y, z = cells.tile_of(block)
    w, s, e, n = merc.tile_box(x, y, z)
    at = tables.read_at(spark, path, (w + e) / 2, (s + n) / 2)
    assert [r.block for r in at.collect()] == [block] and scanned(at) <= 20 < every
    zoom = tables.read_table(spark, path).where(in_zoom(F.col("block"), 4))
    assert scanned(zoom.select("block")) < every / 2
    assert tables.read_tile(spark, path, x, y, z).count() == 1


def test_region_by_statistics_equals_region_by_pixels(spark, table):
    path, _ = table
    t = tables.read_table(spark, path, zoom=fx.ZOOM)
    a = zonal.region_stats(t, "band_1", "float32", STAR, fx.ZOOM, 16, -9999.0).first()
    b = zonal.region_stats(t, "band_1", "float32", STAR, fx.ZOOM, 16, -9999.0, stored=True).first()
    world = zonal.region_stats(t, "band_1", "float32", box_area(-180, -86, 180, 86), fx.ZOOM, 16, -9999.0, stored=True).first()
    assert a["count"] == b["count"] > 0 and a["sum"] == pytest.approx(b["sum"]) and a["stddev"] == pytest.approx(b["stddev"])
    assert world["count"] == t.agg(F.sum("band_1_count")).first()[0]


def test_layouts_are_tables(spark, table, tmp_path):
    path, _ = table
    layout.split_by_zoom(spark, path, str(tmp_path / "z"))
    assert not [r for r in checks.validate(spark, str(tmp_path / "z" / "zoom=5")).collect() if r.severity == "error"]
    assert tables.read_metadata(spark, str(tmp_path / "z" / "zoom=6"))["tiling"]["min_zoom"] == 6
    assert layout.partition(spark, path, str(tmp_path / "p"), 1) == 1
    parts = spark.read.parquet(str(tmp_path / "p"))
    native = tables.read_table(spark, path, zoom=fx.ZOOM)
    assert sorted(r.block for r in parts.where("block <> 0").select("block").collect()) == sorted(r.block for r in native.select("block").collect())
    assert parts.where("block = 0").count() == parts.select("part_file").distinct().count()
    assert layout.partition_zoom(10, 4096, 4096 * 1000, 64_000) == 7 and layout.partition_zoom(10, 3, 300) is None
    assert layout.greedy([5, 9, 3, 2], 10) == [0, 2, 3]


def test_faults_are_found(spark, table, tmp_path):
    path, meta = table
    tiles = tables.read_table(spark, path)
    gone = tiles.where(~in_zoom(F.col("block"), 6)).withColumn("band_2", F.when(F.col("block") == tiles.agg(F.min("block")).first()[0], F.lit(b"\x1f\x8bxx")).otherwise(F.col("band_2")))
    tables.write_table(gone, str(tmp_path / "bad"), meta | {"version": "9", "bands": meta["bands"] + [{"name": "band_9"}]})
    assert {r.message for r in checks.validate(spark, str(tmp_path / "bad")).collect() if r.severity == "error"} >= {"unknown version 9", "band 2 has no type"}
    tables.write_table(gone, str(tmp_path / "bad2"), meta)
    assert any(r.check == "bands" for r in checks.validate(spark, str(tmp_path / "bad2")).collect())
    tables.write_table(tiles.where(~in_zoom(F.col("block"), 6)), str(tmp_path / "bad3"), meta)
    assert "zoom 6 has no tiles" in {r.message for r in checks.validate(spark, str(tmp_path / "bad3")).collect()}
    assert checks.metadata_findings("{", 1)[1][0][0] == "error" and checks.metadata_findings(None, 0)[1]


@pytest.mark.parametrize("how", [*pyramid.REDUCERS, *pyramid.KERNELS])
def test_halving(how):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(16, 16))
    v[0:2, 0:2] = np.nan
    out = pyramid.halved(v, how)
    assert out.shape == (8, 8)
    flat = pyramid.halved(np.full((16, 16), 3.0), how)
    assert np.allclose(flat, 12.0 if how == "sum" else 3.0)
    if how == "average":
        assert np.isnan(out[0, 0]) and out[3, 4] == pytest.approx(v[6:8, 8:10].mean())


def test_slope_of_a_plane(spark):
    z, size = 4, 16
    row = lambda x, y: np.add.outer(np.zeros(size), (np.arange(size) + x * size) * 5.0)
    tiles = spark.createDataFrame([(cells.cell_of(x, y, z), pixels.encode(row(x, y), "float32")) for x in (3, 4) for y in (5, 6)], "block long, band_1 binary")
    for r in pyramid.hillslope(tiles, "band_1", "float32", size, 10.0).collect():
        v = pixels.decode(bytes(r.slope), "float32").reshape(size, size)
        x, _, _ = cells.tile_of(r.block)
        inner = v[:, 1:] if x == 3 else v[:, :-1]
        assert np.allclose(inner, math.degrees(math.atan(0.5)), atol=1e-3)


def test_tiff_round_trip(spark, table, tmp_path):
    path, _ = table
    tiles = tables.read_table(spark, path, ["band_1"])
    w, h = export.export_tiff(tiles, ["band_1"], "float32", 16, 5, str(tmp_path / "x.tif"), -9999.0)
    values, fields = grids.read_tiff((tmp_path / "x.tif").read_bytes())
    assert values.shape == (h, w, 1) and fields[42113] == b"-9999.0"
    x, y = grids.tiff_pixels(values, fields)
    for r in tiles.where(in_zoom(F.col("block"), 5)).collect():
        tx, ty, _ = cells.tile_of(r.block)
        unit = merc.CIRCLE / 32
        c, t = np.argmin(np.abs(x - (tx * unit - merc.CIRCLE / 2 + unit / 32))), np.argmin(np.abs(y - (merc.CIRCLE / 2 - ty * unit - unit / 32)))
        assert (values[t : t + 16, c : c + 16, 0] == pixels.decode(bytes(r.band_1), "float32").reshape(16, 16)).all()
    rgb = np.arange(20 * 33 * 3).reshape(20, 33, 3).astype("u1")
    assert (grids.read_tiff(export.tiff(rgb, 0, 0, 1, 16))[0] == rgb).all()
    with pytest.raises(ValueError):
        export.export_tiff(tiles, ["band_1"], "float32", 16, 8, str(tmp_path / "y.tif"), most_pixels=10)


def test_ascii_grid_to_table_and_sink(spark, tmp_path):
    (tmp_path / "g.asc").write_text("ncols 4\nnrows 3\nxllcorner 10\nyllcorner 20\ncellsize 1\nNODATA_value -9999\n1 2 3 4\n5 -9999 7 8\n9 10 11 12\n")
    grids.register(spark)
    df = spark.read.format("ascii_grid").option("rows_per_partition", 1).load(str(tmp_path / "g.asc"))
    rows = {(r.lon, r.lat): r.value for r in df.collect()}
    assert rows[(10.5, 22.5)] == 1 and rows[(13.5, 20.5)] == 12 and len(rows) == 11
    from tilecairn.cli import main

    out = str(tmp_path / "t")
    assert main(["convert", str(tmp_path / "g.asc"), out, "--zoom", "7", "--block-size", "16", "--min-zoom", "5", "--tile-stats"], spark) == 0
    assert main(["validate", out], spark) == 0 and main(["inspect", out, "--json"], spark) == 0
    assert main(["export", out, str(tmp_path / "o.tif")], spark) == 0 and main(["split-zoom", out, str(tmp_path / "s")], spark) == 0
    tables.read_table(spark, out).orderBy("block").coalesce(1).write.format("tile_files").option("path", str(tmp_path / "f")).option("footer.tiles:version", "0.5.0").option("group_rows", "2").mode("append").save()
    import pyarrow.parquet as pq

    m = pq.ParquetFile(next((tmp_path / "f").glob("*.parquet"))).metadata
    assert m.metadata[b"tiles:version"] == b"0.5.0" and m.row_group(0).num_rows == 2 and m.row_group(0).sorting_columns


def test_services(spark):
    calls = []

    def flaky(url, parameters):
        calls.append(parameters)
        return (429, {"Retry-After": "7"}, b"") if len(calls) == 1 else (500, {}, b"") if len(calls) == 2 else (200, {}, b"ok")

    waits = []
    assert services.request("u", {}, get=flaky, sleep=waits.append) == b"ok" and waits == [7.0, 2.0]
    with pytest.raises(PermissionError):
        services.request("u", {}, get=lambda u, p: (403, {}, b""))
    with pytest.raises(FileNotFoundError):
        services.request("u", {}, get=lambda u, p: (404, {}, b""))
    with pytest.raises(ConnectionError):
        services.request("u", {}, get=lambda u, p: (503, {}, b""), sleep=lambda s: None)
    with pytest.raises(ValueError):
        services.intersected((0, 0, 1, 1), (2, 2, 3, 3))
    meta = services.service_metadata("u", get=lambda u, p: (200, {}, json.dumps({"extent": {}, "pixelType": "S16", "bandCount": 1, "noDataValue": 0}).encode()))
    assert meta["type"] == "int16"
    body = export.tiff(np.arange(256).reshape(16, 16).astype("i2"), 0, 0, 1, 16)

    def server(url, p):
        return 200, {}, body if url.endswith("exportImage") else json.dumps({"extent": {}, "pixelType": "S16", "bandCount": 1, "noDataValue": 0}).encode()

    wanted = spark.createDataFrame([(1, 2, 3, cells.cell_of(1, 2, 3))], "x long, y long, z int, block long")
    rows = services.service_tiles(spark, "u", wanted, 16, get=server).collect()
    assert (pixels.decode(bytes(rows[0].band_1), "int16") == np.arange(256)).all()

    class Job:
        states = [{"state": "RUNNING"}, {"state": "COMPLETED", "path": "p"}]

        def start(self, asset, transform):
            return 1

        def state(self, job):
            return self.states.pop(0)

    assert services.ExportJob(Job(), "a", []).wait(sleep=lambda s: None) == "p"


def test_time_axes(spark):
    r = one(spark, cftime.parse_units(F.lit("minutes since 1980-01-01")), cftime.parse_units(F.lit("fortnights since 1980-01-01")))
    assert r[0].unit == "minutes" and r[1] is None
    at = lambda v, c="standard": cftime.to_timestamp(F.lit(v), F.lit("minutes"), F.lit("1980-01-01").cast("timestamp_ntz"), F.lit(c))
    month = cftime.to_timestamp(F.lit(1.0), F.lit("months"), F.lit("2001-01-31").cast("timestamp_ntz"))
    r = one(spark, at(44640.0), at(1.0, "360_day"), month)
    assert str(r[0]) == "1980-02-01 00:00:00" and r[1] is None and r[2] is None
    df = spark.createDataFrame([("a", v) for v in (0.0, 31.0, 59.0)] + [("b", 1.0)], "k string, v double")
    assert {x.k: x.regular for x in cftime.axis_interval(df, ["k"], "v").collect()} == {"a": False, "b": None}


def test_old_and_special_metadata():
    assert metadata.plain_nodata(float("nan")) == "NaN" and metadata.plain_nodata(-math.inf) == "-Infinity" and metadata.plain_nodata(5.0) == 5
    with pytest.raises(ValueError):
        metadata.parse(None)
    b = metadata.Band("band_1", "uint8", statistics={"min": math.nan}).document()
    assert b["STATISTICS_MINIMUM"] is None
    assert export.COLOURS[2] == "palette" and export.COLOURS[28] == "sar_s" and len(export.COLOURS) == 31
    assert export.png([np.zeros(256, "u1")], 16)[:4] == b"\x89PNG"


def test_stream_equals_batch(spark, tmp_path):
    from tilecairn.streaming.tiles import cell_windows

    p = fx.points(spark, D).withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "value", "lon", "lat")
    p.repartition(2).write.parquet(str(tmp_path / "in"))
    q = cell_windows(spark.readStream.schema(p.schema).parquet(str(tmp_path / "in")), 3).writeStream.outputMode("complete").format("memory").queryName("cells").start()
    try:
        q.processAllAvailable()
        assert sorted(map(str, spark.table("cells").collect())) == sorted(map(str, cell_windows(p, 3).collect()))
    finally:
        q.stop()


def test_summary_of_null_blobs(spark):
    df = spark.createDataFrame([(None,), (pixels.encode(np.full(4, np.nan), "float32"),)], "b binary")
    assert [r.s["count"] for r in df.select(summary_udf("float32")("b").alias("s")).collect()] == [None, None]
