"""Raster files, resampling, exports, services, SQL and plans against brute force."""

import json
import math
import struct
import sys
import time
import types
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tilecairn import fixtures as fx
from tilecairn import sql
from tilecairn.cli import main
from tilecairn.functions import cells, cftime, pixels, projections
from tilecairn.functions import mercator as merc
from tilecairn.functions.geometry import Area, box_area, cover
from tilecairn.operators import convert, export, ingest, layout, pyramid, zonal
from tilecairn.sources import rasters, remote, services, tables

D = "/root/testdata/sf0.001"


def lzw(data):
    """Codes as the format has them: the width grows one code early."""
    out, bits, held = bytearray(), 0, 0

    def put(code, width):
        nonlocal bits, held
        bits, held = bits << width | code, held + width
        while held >= 8:
            out.append(bits >> held - 8 & 255)
            held -= 8
            bits &= (1 << held) - 1

    table, width, word = {bytes([i]): i for i in range(256)}, 9, b""
    put(256, 9)
    for b in data:
        more = word + bytes([b])
        if more in table:
            word = more
            continue
        put(table[word], width)
        table[more] = len(table) + 2
        width = 9 if len(table) + 2 < 512 else (len(table) + 2).bit_length()
        word = bytes([b])
        if len(table) + 2 >= 4094:
            put(table[word], width)
            put(256, width)
            table, width, word = {bytes([i]): i for i in range(256)}, 9, b""
    if word:
        put(table[word], width)
        table[word + b"\0"] = len(table) + 2
        width = 9 if len(table) + 2 < 512 else (len(table) + 2).bit_length()
    put(257, width)
    put(0, 7)
    return bytes(out)


def packbits(data):
    return b"".join(bytes([len(data[i : i + 100]) - 1]) + data[i : i + 100] for i in range(0, len(data), 100))


PACK = {1: lambda d: d, 5: lzw, 8: zlib.compress, 32773: packbits}


def tiff(values, order="<", compression=1, predictor=1, rows=7, apart=False, big=False, epsg=3857, origin=(0.0, 0.0), step=1000.0, nodata=None):
    """A TIFF in strips, written plainly."""
    h, w, n = values.shape
    dtype = values.dtype.newbyteorder(order)
    strips = []
    for part in [values[..., i : i + 1] for i in range(n)] if apart else [values]:
        for y in range(0, h, rows):
            cut = part[y : y + rows]
            if predictor == 2:
                cut = np.concatenate([cut[:, :1], np.diff(cut.astype("i8"), axis=1).astype(values.dtype)], axis=1)
            raw = cut.astype(dtype).tobytes()
            if predictor == 3:
                flat = np.frombuffer(cut.astype(values.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(len(cut), -1, values.dtype.itemsize).transpose(0, 2, 1).reshape(len(cut), -1, cut.shape[2])
                raw = np.concatenate([flat[:, :1], np.diff(flat.astype("i2"), axis=1).astype(np.uint8)], axis=1).tobytes()
            strips.append(PACK[compression](raw))
    word = "Q" if big else "I"
    fields = [(256, "I", [w]), (257, "I", [h]), (258, "H", [values.dtype.itemsize * 8] * n), (259, "H", [compression]), (262, "H", [1]), (273, word, [0] * len(strips)), (277, "H", [n]), (278, "I", [rows]), (279, word, [len(s) for s in strips]), (284, "H", [2 if apart else 1]), (317, "H", [predictor]), (339, "H", [{"u": 1, "i": 2, "f": 3}[values.dtype.kind]] * n), (33550, "d", [step, step, 0.0]), (33922, "d", [0.0, 0.0, 0.0, *origin, 0.0]), (34735, "H", [1, 1, 0, 2, 1024, 0, 1, 2 if epsg == 4326 else 1, 2048 if epsg == 4326 else 3072, 0, 1, epsg])]
    if nodata is not None:
        fields.append((42113, "s", str(nodata).encode() + b"\0"))
    head, each, inline = (16, 20, 8) if big else (8, 12, 4)
    at, places = head, []
    for s in strips:
        places.append(at)
        at += len(s)
    fields = [(t, c, places if t == 273 else v) for t, c, v in fields]
    out, extra, directory = b"".join(strips), b"", b""
    start = at
    codes = {"H": 3, "I": 4, "d": 12, "Q": 16, "s": 2}
    after = start + (8 if big else 2) + each * len(fields) + inline
    for t, c, v in fields:
        body = v if c == "s" else struct.pack(f"{order}{len(v)}{c}", *v)
        held = body.ljust(inline, b"\0") if len(body) <= inline else struct.pack(order + word, after + len(extra))
        extra += body if len(body) > inline else b""
        directory += struct.pack(order + "HH" + word, t, codes[c], len(v)) + held
    mark = b"II" if order == "<" else b"MM"
    first = struct.pack(order + "2sHHHQ", mark, 43, 8, 0, start) if big else struct.pack(order + "2sHI", mark, 42, start)
    return first + out + struct.pack(order + ("Q" if big else "H"), len(fields)) + directory + b"\0" * inline + extra


@pytest.mark.parametrize("compression", list(PACK))
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("kind,predictor", [("u1", 1), ("u2", 2), ("f4", 3), ("f8", 1), ("i4", 2)])
def test_tiff_variants(tmp_path, compression, order, kind, predictor):
    rng = np.random.default_rng(3)
    v = (np.cumsum(rng.integers(0, 9, (60, 53, 2)), axis=1) % 250).astype(kind)
    for apart, big in ((False, False), (True, True)):
        path = tmp_path / "x.tif"
        path.write_bytes(tiff(v, order, compression, predictor, apart=apart, big=big, nodata=7))
        i = rasters.open_image(str(path))
        assert (i.width, i.height, i.bands, i.nodata, i.crs, i.step) == (53, 60, 2, 7, "EPSG:3857", (1000.0, -1000.0))
        assert (i.window(0, 60, 0, 53) == v.transpose(2, 0, 1)).all() and (i.window(5, 31, 11, 40) == v[5:31, 11:40].transpose(2, 0, 1)).all()


def test_lzw_beyond_one_table():
    rng = np.random.default_rng(1)
    for data in (bytes(rng.integers(0, 256, 30_000, np.uint8)), bytes(rng.integers(0, 3, 60_000, np.uint8)), b"a", b""):
        assert rasters._lzw(lzw(data)) == data


def test_files_that_can_not_be_read(tmp_path):
    path = tmp_path / "x.tif"
    path.write_bytes(tiff(np.zeros((3, 3, 1), "u1"), epsg=32767))
    assert rasters.open_image(str(path)).crs == "EPSG:4326"
    with pytest.raises(ValueError):
        rasters.open_image(str(path), assume_lonlat=False)
    with pytest.raises(ValueError):
        rasters.open_image(__file__)
    with pytest.raises(ValueError):
        projections.from_degrees(0, 0, "EPSG:2154")


def test_projections():
    lon, lat = np.array([9.0, 6.3, 11.9, -3.7]), np.array([48.0, 10.0, 70.0, 40.4])
    for crs in ("EPSG:32632", "EPSG:3857", "EPSG:4326", "EPSG:25832"):
        back = projections.to_degrees(*projections.from_degrees(lon, lat, crs), crs)
        assert np.allclose(back, (lon, lat), atol=1e-9)
    x, y = projections.from_degrees(9.0, 48.0, "EPSG:32632")  # on the central meridian: the scaled arc from the equator
    assert x == pytest.approx(500_000) and y == pytest.approx(5_316_300.22, abs=0.01)
    assert projections.from_degrees(-63.0, -30.0, "EPSG:32720")[1] == pytest.approx(10_000_000 - 3_318_785.4, abs=1)
    assert projections.box_to_degrees((0, 0, 111_319.4907932736, 1), "EPSG:3857")[2] == pytest.approx(1)


def brute(values, y, x, sy, sx, how):
    """A pixel at a time."""
    h, w = np.broadcast(y, x).shape
    Y, X, SY, SX = (np.broadcast_to(v, (h, w)) for v in (y, x, sy, sx))
    out = np.full((h, w), np.nan)
    for i in range(h):
        for j in range(w):
            a, b = Y[i, j], X[i, j]
            if not (0 <= a < values.shape[0] and 0 <= b < values.shape[1]):
                continue
            near = values[int(a), int(b)]
            if how == "near":
                out[i, j] = near
            elif how in pyramid.KERNELS:
                total = weight = 0.0
                for p in range(values.shape[0]):
                    for q in range(values.shape[1]):
                        v = values[p, q]
                        k = pyramid._kernel(how, np.array((p + 0.5 - a) / max(1, SY[i, j]))) * pyramid._kernel(how, np.array((q + 0.5 - b) / max(1, SX[i, j])))
                        if v == v:
                            total, weight = total + k * v, weight + k
                out[i, j] = total / weight if near == near and abs(weight) > 1e-9 else np.nan
            else:
                rows = [p for p in range(values.shape[0]) if a - SY[i, j] / 2 <= p + 0.5 < a + SY[i, j] / 2] or [int(a)]
                columns = [q for q in range(values.shape[1]) if b - SX[i, j] / 2 <= q + 0.5 < b + SX[i, j] / 2] or [int(b)]
                out[i, j] = pyramid.REDUCERS[how](np.array([[values[p, q] for p in rows for q in columns]]))[0]
    return out


@pytest.mark.parametrize("how", [*pyramid.REDUCERS, *pyramid.KERNELS])
@pytest.mark.parametrize("scale", [0.3, 1.0, 2.6])
def test_resampling_by_brute_force(how, scale):
    rng = np.random.default_rng(5)
    v = np.rint(rng.normal(size=(14, 17)) * 4)
    v[3:6, 4:9] = np.nan
    y, x = (np.arange(9) * scale - 1.03)[:, None], (np.arange(11) * scale + 0.41)[None, :]
    sy, sx = np.full((9, 1), scale), np.full((1, 11), scale)
    assert np.allclose(ingest.resampled(v, y, x, sy, sx, how), brute(v, y, x, sy, sx, how), equal_nan=True)
    both = ingest.resampled(v, np.broadcast_to(y, (9, 11)), np.broadcast_to(x, (9, 11)), np.full((9, 11), scale), np.full((9, 11), scale), how)
    assert np.allclose(both, brute(v, y, x, sy, sx, how), equal_nan=True)


def test_finer_tiles_have_no_holes(spark, tmp_path):
    (tmp_path / "g.asc").write_text("ncols 4\nnrows 4\nxllcorner 10\nyllcorner 20\ncellsize 1\n" + "\n".join(" ".join(str(4 * i + j) for j in range(4)) for i in range(4)) + "\n")
    t = ingest.raster_tiles(spark, str(tmp_path / "g.asc"), zoom=8, block_size=16).collect()
    n = sum(pixels.valid(pixels.decode(bytes(r.band_1), "float32"), -9999.0).sum() for r in t)
    unit = 360 / (256 * 16)
    rows = (merc.tile_at(0, 20, 12)[1] - merc.tile_at(0, 24, 12)[1])
    assert abs(n - 4 / unit * rows) < 100 and n > 2000


def test_utm_raster(spark, tmp_path):
    v = np.add.outer(np.arange(40), np.arange(50)).astype("f4")[..., None]
    (tmp_path / "u.tif").write_bytes(tiff(v, epsg=32632, origin=(480_000.0, 5_340_000.0), step=1000.0, compression=8))
    path = str(tmp_path / "u.tif")
    for how in ("near", "bilinear", "average"):
        for r in ingest.raster_tiles(spark, path, zoom=10, block_size=16, resampling=how).collect():
            x, y, z = cells.tile_of(r.block)
            got = pixels.decode(bytes(r.band_1), "float32").reshape(16, 16)
            for i, j in ((3, 4), (11, 9)):
                lon = (x * 16 + j + 0.5) / (16 << z) * 360 - 180
                lat = math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * (y * 16 + i + 0.5) / (16 << z)))))
                e, n = projections.from_degrees(lon, lat, "EPSG:32632")
                c, t = (e - 480_000) / 1000, (5_340_000 - n) / 1000
                if 3 < c < 47 and 3 < t < 37:
                    assert got[i, j] == pytest.approx(c + t - 1, abs=1.01 if how == "near" else 0.8)


def test_geometry_of_a_raster():
    i = rasters.Image(256, 256, 1, "uint8", crs="EPSG:3857", origin=(-merc.CIRCLE / 2, merc.CIRCLE / 2), step=(merc.CIRCLE / 256, -merc.CIRCLE / 256))
    g = ingest.geometry(i)
    assert (g.zoom, g.tiles(0), g.tiles(1)) == (0, (0, 0, 0, 0), (0, 1, 0, 1)) and len(g.children(0, 0, 0)) == 4
    part = ingest.geometry(rasters.Image(512, 512, 1, "uint8", crs="EPSG:3857", origin=(0.0, 1e6), step=(3000.0, -3000.0)), convert.ZoomStrategy.UPPER)
    assert part.zoom == ingest.geometry(rasters.Image(512, 512, 1, "uint8", crs="EPSG:3857", origin=(0.0, 1e6), step=(3000.0, -3000.0)), convert.ZoomStrategy.LOWER).zoom + 1
    assert part.children(*(part.tiles(3)[k] for k in (0, 2)), 3) and part.least_zoom < part.zoom


def test_source_overviews_are_used(spark, tmp_path):
    native = spark.createDataFrame([(cells.cell_of(x, y, 6), pixels.encode(np.full(256, 10.0), "float32")) for x in (32, 33, 34, 35) for y in (28, 29, 30, 31)] + [(cells.cell_of(x, y, 5), pixels.encode(np.full(256, 77.0), "float32")) for x in (16, 17) for y in (14, 15)], "block long, band_1 binary")
    path = str(tmp_path / "o.tif")
    export.export_tiff(native, ["band_1"], "float32", 16, 6, path, -1.0, least_zoom=5)
    assert [o.width for o in rasters.open_image(path).overviews] == [32]
    ingest.convert_raster(spark, path, str(tmp_path / "t"), block_size=16, zoom=6, least_zoom=4, tile_statistics=True)
    means = {r.z: r.m for r in tables.read_table(spark, str(tmp_path / "t")).groupBy(cells.resolution(F.col("block")).alias("z")).agg(F.max("band_1_max").alias("m")).collect()}
    assert means == {6: 10.0, 5: 77.0, 4: 77.0}


def test_overviews_of_a_raster_that_begins_between_tiles(spark, tmp_path):
    rng = np.random.default_rng(4)
    fine = rng.integers(1, 250, (5 * 16, 7 * 16)).astype("u1")  # tiles 3..9 x 5..9 of zoom 6
    native = spark.createDataFrame([(cells.cell_of(3 + x, 5 + y, 6), pixels.encode(fine[16 * y : 16 * y + 16, 16 * x : 16 * x + 16], "uint8")) for x in range(7) for y in range(5)], "block long, band_1 binary")
    t = pyramid.pyramid(native, ["band_1"], "uint8", 16, 6, 4, "max", 0)
    assert export.export_tiff(t, ["band_1"], "uint8", 16, 6, str(tmp_path / "o.tif"), 0, least_zoom=4) == (112, 80)
    image = rasters.open_image(str(tmp_path / "o.tif"))
    assert (image.window(0, 80, 0, 112)[0] == fine).all() and [(o.width, o.height) for o in image.overviews] == [(56, 40), (28, 20)]
    for o, f in zip(image.overviews, (2, 4), strict=True):
        assert o.origin == image.origin
        want = fine.reshape(80 // f, f, 112 // f, f).max(axis=(1, 3))
        assert (o.window(0, o.height, 0, o.width)[0] == want).all()


def test_command_line_round_trip(spark, tmp_path, capsys):
    rng = np.random.default_rng(2)
    v = rng.integers(1, 200, (64, 96, 3)).astype("u1")
    unit = merc.CIRCLE / 16 / (1 << 6)
    (tmp_path / "rgb.tif").write_bytes(tiff(v, compression=5, origin=(0.0, unit * 64), step=unit, nodata=0))
    src, table, out = (str(tmp_path / n) for n in ("rgb.tif", "t", "back.tif"))
    assert main(["convert", "geotiff", src, table, "--block-size", "16", "--band-layout", "interleaved", "--overviews", "auto", "--min-zoom", "4", "--tile-stats"], spark) == 0
    assert main(["validate", table, "--json"], spark) == 0 and main(["inspect", table], spark) == 0
    assert main(["export", "geotiff", table, out], spark) == 0
    back = rasters.open_image(out)
    assert (back.window(0, 64, 0, 96) == v.transpose(2, 0, 1)).all() and [(o.width, o.height) for o in back.overviews] == [(48, 32), (24, 16)]
    assert main(["split-zoom", table, str(tmp_path / "z")], spark) == 0 and main(["partition", table, str(tmp_path / "p"), "--zoom", "3"], spark) == 0
    capsys.readouterr()
    assert main(["sql", f"SELECT num_blocks FROM read_tiles_metadata('{table}')"], spark) == 0 and "24" in capsys.readouterr().out
    for bad in (["convert", "imageserver"], ["export", "pdf", "a", "b"], ["convert", "raster", "a", "b", "--resampling", "best"]):
        with pytest.raises(SystemExit):
            main(bad, spark)
    with pytest.raises(FileExistsError):
        main(["convert", src, table, "--block-size", "16"], spark)


def test_color_tables_and_interpretations(spark, tmp_path):
    t = spark.createDataFrame([(cells.cell_of(1, 1, 2), pixels.encode(np.arange(256) % 3, "uint8"))], "block long, band_1 binary")
    export.export_tiff(t, ["band_1"], "uint8", 16, 2, str(tmp_path / "p.tif"), colours={"1": [255, 0, 0, 255]}, interpretations=["palette"], descriptions=["land & sea"])
    found = rasters.info(str(tmp_path / "p.tif"))
    assert found["bands"][0]["colorinterp"] == "palette" and found["palette"]["1"] == [255, 0, 0, 255] and found["bands"][0]["description"] == "land & sea"
    with pytest.raises(ValueError):
        export.export_tiff(t, ["band_1"], "uint8", 16, 2, str(tmp_path / "q.tif"), interpretations=["puce"])


def test_files_have_footers_and_stay(spark, tmp_path):
    t = fx.float_tiles(spark, D).select("block", "band_1")
    path = str(tmp_path / "t")
    tables.write_table(t, path, {"bands": []}, group_rows=3, file_rows=5)
    files = [pq.ParquetFile(f) for f in (tmp_path / "t").glob("*.parquet")]
    assert all(f.metadata.metadata[b"tiles:version"] == b"0.5.0" and f.metadata.row_group(0).sorting_columns and f.metadata.row_group(0).column(0).has_offset_index for f in files)
    assert max(f.metadata.num_rows for f in files) == 5 and all(f.metadata.row_group(i).num_rows <= 3 for f in files for i in range(f.num_row_groups))
    n = tables.read_table(spark, path).count()
    with pytest.raises(FileExistsError):
        tables.write_table(t, path, {"bands": []})
    tables.write_table(t, path, {"bands": []}, mode="append")
    assert tables.read_table(spark, path).count() == 2 * n == 2 * t.count()
    tables.write_table(t, path, {"bands": []}, mode="overwrite")
    assert tables.read_table(spark, path).count() == n


def plan_nodes(df):
    """The nodes of the plan that ran: name and output types."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        out.append((name, p.output().toString(), p.schema().catalogString()))
        todo += [p.children().apply(i) for i in range(p.children().size())]
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        if "QueryStage" in name:
            todo.append(p.plan())
    return out


def test_blobs_are_neither_shuffled_nor_decoded_twice(spark):
    tiles = fx.float_tiles(spark, D).drop("t")
    from tilecairn.plans.scratch import cut

    tiles = cut(tiles)
    from tilecairn.catalogue import _on_tiles

    points = _on_tiles(spark, D)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = plan_nodes(zonal.values_at(points, tiles, "band_1", "float32", 8, 16))
        assert sum("MapInArrow" in n for n, _, _ in found) == 1
        assert not any("ArrowEval" in n for n, _, _ in found)
        assert not any(n == "ShuffleExchangeExec" and "binary" in s for n, _, s in found)
        found = plan_nodes(zonal.zonal_stats(tiles, fx.zone_boxes(spark, D), "band_1", "float32", 8, 16))
        assert not any(n == "ShuffleExchangeExec" and "binary" in s for n, _, s in found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_zones_on_both_ways(spark, monkeypatch, limit):
    monkeypatch.setattr(zonal, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(zonal, "ZONES_AT_ONCE", 2)
    tiles = fx.float_tiles(spark, D).drop("t")
    zones = spark.createDataFrame([(i, f"POLYGON(({-170 + i} -60, {20 + i} -60, {100 - i} 60, -160 60))") for i in range(7)] + [(99, None)], "zone int, wkt string")
    got = {r.zone: r["sum"] for r in zonal.zonal_stats(tiles, zones, "band_1", "float32", 8, 16).collect()}
    for r in zones.where("wkt is not null").collect():
        area = zonal.parse_wkt(r.wkt)
        one = zonal.region_stats(tiles, "band_1", "float32", area, 8, 16).first()
        assert got[r.zone] == pytest.approx(one["sum"], abs=1e-6)
    assert 99 not in got


def test_covers_of_fine_zooms_are_fast():
    circle = Area(((tuple((-3 + 0.36 * math.cos(2 * math.pi * i / 400), 40 + 0.28 * math.sin(2 * math.pi * i / 400)) for i in range(400)),),))
    began = time.time()
    found = cover(circle, 17)
    assert time.time() - began < 1 and len(found.first) > 1000
    assert cover(box_area(-180, -85, 180, 85), 12).first.size > 4000  # no bound


def test_rows_that_are_sent_are_exact():
    rng = np.random.default_rng(0)
    for kind in ("uint8", "int16", "float32", "float64"):
        v = rng.integers(0, 100, 64).astype("f8")
        v[rng.random(64) < 0.3] = np.nan
        assert np.array_equal(pyramid._received(pyramid._sent(v, kind), kind, 64), v, equal_nan=True)


def test_time_without_a_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        p = cftime.parse_units(F.lit("days since 2020-01-01"))
        gap = cftime.parse_units(F.lit("minutes since 2020-03-29 02:30"))
        at = lambda v, u: cftime.to_timestamp(F.lit(v), u["unit"], u["reference"]).cast("string")
        month = cftime.to_timestamp(F.lit(2.0), F.lit("months"), F.lit("2020-01-29 02:30:00").cast("timestamp_ntz")).cast("string")
        r = spark.range(1).select(at(180.0, p), at(0.5, p), at(0.0, gap), month, at(float("nan"), p)).first()
        assert tuple(r) == ("2020-06-29 00:00:00", "2020-01-01 12:00:00", "2020-03-29 02:30:00", "2020-03-29 02:30:00", None)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_service_plans(spark, tmp_path):
    info = {"extent": {"xmin": 0.0, "ymin": 0.0, "xmax": 1e6, "ymax": 1e6, "spatialReference": {"wkid": 102100}}, "pixel": 1000.0}
    zoom, box = services.service_plan(info, 256, (0.0, 0.0, 1.0, 1.0))
    assert box == (0.0, 0.0, 1.0, 1.0) and merc.CIRCLE / 256 / (1 << zoom) <= 1000 < merc.CIRCLE / 256 / (1 << zoom - 1)
    assert services.service_plan(info, 256, (0, 0, 1e5, 1e5), "EPSG:3857")[1][2] == pytest.approx(0.898315, abs=1e-5)
    with pytest.raises(ValueError):
        services.service_plan(info, 256, (-50.0, 0.0, -49.0, 1.0))
    assert services.reference_system({"wkid": 102113}) == "EPSG:3785" and services.reference_system(None) == "EPSG:4326" and services.reference_system({"latestWkid": 32632}) == "EPSG:32632"
    from tilecairn.catalogue import _pretended

    found = services.convert_service(spark, "http://example.org/s", str(tmp_path / "t"), size=16, skip_empty=False, get=_pretended)
    assert (found["blocks"], found["asked"], found["zoom"]) == (16, 16, 4) and found["bytes"] > 0


class Exporter:
    def __init__(self, path):
        self.calls, self.path = [], path

    def sign_in(self, credentials):
        self.calls.append(("sign_in", credentials))

    def image(self, asset, expression, bands):
        self.calls.append(("image", asset, expression, bands))
        return "image"

    def start(self, asset, transform):
        self.calls.append(("start", asset, transform[0]))
        return 1

    def state(self, job):
        return {"state": "COMPLETED", "path": self.path}

    def delete(self, path):
        self.calls.append(("delete", path))


def test_remote_exports(spark, tmp_path):
    (tmp_path / "e.tif").write_bytes(tiff(np.ones((16, 16, 1), "u1"), step=merc.CIRCLE / 16 / (1 << 8)))
    e = Exporter(str(tmp_path / "e.tif"))
    meta = remote.convert_export(spark, e, "expr: a + b", str(tmp_path / "t"), 8, credentials="k", block_size=16)
    assert meta["tiling"]["max_zoom"] == 8 and [c[0] for c in e.calls] == ["sign_in", "image", "start", "delete"] and e.calls[1][2] == "a + b"
    with pytest.raises(RuntimeError):
        e.state = lambda job: {"state": "FAILED"}
        remote.convert_export(spark, e, "a/b", str(tmp_path / "u"), 8)
    with pytest.raises(ZeroDivisionError):  # what the service wrote goes after an error too
        e = Exporter("x")
        remote.convert_export(spark, e, "a/b", "u", 8, convert=lambda *a, **k: 1 / 0)
    assert e.calls[-1] == ("delete", "x")
    for bad in ("expr:", "a b", ""):
        with pytest.raises(ValueError):
            remote.parse_asset(bad)


def test_listings(spark):
    items = [{"title": f"n{40 + i}w106", "downloadURL": f"u{i}", "sizeInBytes": i, "publicationDate": "2020-01-01", "boundingBox": {"minX": -106 + i, "maxX": -105 + i, "minY": 40, "maxY": 41}} for i in range(5)]

    def offsets(url, p):
        return 200, {}, json.dumps({"items": items[p["offset"] : p["offset"] + p["max"]], "total": 5}).encode()

    found = remote.listing(spark, lambda after: remote.elevation_page("u", (-106, 40, -100, 41), after, 2, get=offsets))
    assert found.count() == 5 and remote.in_box(found, (-104.5, 40, -103.5, 41)).count() == 2

    def tokens(url, p):
        page = int(p.get("continuation-token", 0))
        more = f"<IsTruncated>true</IsTruncated><NextContinuationToken>{page + 1}</NextContinuationToken>" if page < 2 else "<IsTruncated>false</IsTruncated>"
        keys = "".join(f"<Contents><Key>d/n{41 + page}w10{k}.{e}</Key><LastModified>2021-02-03T00</LastModified><Size>9</Size></Contents>" for k, e in ((5, "tif"), (6, "xml")))
        return 200, {}, f"<ListBucketResult xmlns='x'>{keys}{more}</ListBucketResult>".encode()

    found = remote.listing(spark, lambda after: remote.bucket_page("http://b", "d/", after, get=tokens)).collect()
    assert [(r.name, r.west, r.north, r.date) for r in found] == [(f"n{41 + i}w105.tif", -105.0, 41.0 + i, "2021-02-03") for i in range(3)]


def test_sql_text(spark):
    calls = list(sql._calls("select 'st_clip(x)', f(st_clip(a, g('b, (c'), d)) from t", ["st_clip"]))
    assert [c[3] for c in calls] == [["a", "g('b, (c')", "d"]]
    assert sql._literal("st_point(1, -2.5)") == "POINT(1.0 -2.5)" and sql._literal("'it''s'") == "it's" and sql._literal("3") == 3
    with pytest.raises(ValueError):
        list(sql._calls("st_clip(a", ["st_clip"]))
    nothing = sql.query(spark, "SELECT st_rastervalue(5202361257054699519, null, st_point(0, 0), '{}') AS v, st_intersects(cell_from_point(10, 10, 4), st_point(10, 10)) AS i").first()
    assert nothing.v is None and nothing.i


def test_lossy_codecs_need_a_library(monkeypatch):
    bands = [np.arange(256).astype("u1")] * 3
    monkeypatch.setitem(sys.modules, "PIL", None)
    with pytest.raises(ValueError):
        pixels.encode_bands(bands, "uint8", "webp")

    class Picture:
        def __init__(self, values):
            self.values = values

        def save(self, out, format, quality):
            np.save(out, self.values)

        def __array__(self, dtype=None, copy=None):
            return self.values

    library = types.ModuleType("PIL")
    library.Image = types.SimpleNamespace(fromarray=Picture, open=lambda f: Picture(np.load(f)))
    monkeypatch.setitem(sys.modules, "PIL", library)
    assert (pixels.decode_bands(pixels.encode_bands(bands, "uint8", "webp", 90), "uint8", 3, "webp") == bands).all()
    for wrong in ((bands[:2], "uint8", 90), (bands, "uint16", 90), (bands, "uint8", 0)):
        with pytest.raises(ValueError):
            pixels.encode_bands(wrong[0], wrong[1], "jpeg", wrong[2])


def test_greedy_rows(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 9.0), ("a", 3, 3.0), ("a", 4, 2.0), ("b", 1, 20.0)], "g string, i int, size double")
    assert sorted((r.g, r.i) for r in layout.greedy_rows(df, ["i"], "size", 10.0, "g").collect()) == [("a", 1), ("a", 3), ("a", 4)]
