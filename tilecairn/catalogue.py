"""The named queries over the tables of a data directory, and DuckDB SQL that gives the same rows.

The SQL works from the source tables alone; it never sees a blob, so equal results also test the codec.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilecairn import fixtures as fx
from tilecairn import sql as names
from tilecairn.functions import cells, cftime
from tilecairn.functions import mercator as merc
from tilecairn.functions import pixels as px
from tilecairn.functions import stats as st
from tilecairn.functions.geometry import box_area, parse_wkt
from tilecairn.operators import checks, convert, export, ingest, layout, pyramid, zonal
from tilecairn.plans.ranges import in_zoom, intersects
from tilecairn.plans.scratch import new_folder
from tilecairn.sources import metadata as meta_
from tilecairn.sources import services, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SIZE, Z, GZ, NODATA = fx.SIZE, fx.ZOOM, fx.GRID_ZOOM, fx.NODATA


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r(c: Column | str, n: int = 4) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, n) + F.lit(0.0)


def q(text: str, n: int = 4) -> str:
    return f"round({text}, {n}) + 0.0"


# Pieces of SQL.


def cell_sql(x: str, y: str, z: int) -> str:
    bits = " + ".join(f"(((({x})::bigint >> {i}) & 1) << {2 * i}) + (((({y})::bigint >> {i}) & 1) << {2 * i + 1})" for i in range(z)) or "0"
    return f"({cells.BASE} + ({z}::bigint << 52) + (({bits}) << {52 - 2 * z}) + {(1 << (52 - 2 * z)) - 1})"


def x_sql(lon: str, z: int) -> str:
    return f"greatest(0, least({(1 << z) - 1}, floor((({lon}) / 360.0 + 0.5) * {1 << z})))::bigint"


def y_sql(lat: str, z: int) -> str:
    s = f"sin(radians(({lat})::double))"
    return f"greatest(0, least({(1 << z) - 1}, floor((0.5 - 0.25 * ln((1 + {s}) / (1 - {s})) / pi()) * {1 << z})))::bigint"


def lat_sql(y: str, z: int) -> str:
    return f"degrees(atan(sinh(pi() * (1 - 2 * ({y}) / {1 << z}.0))))"


POINTS = "points AS (SELECT *, -180 + (event_id * 37 % 3600) / 10.0::double AS lon, -80 + (event_id * 91 % 1600) / 10.0::double AS lat FROM events)"
FULL = f"""full_t AS (SELECT vec_id // 4 AS t FROM embeddings WHERE len(embedding) = 64 GROUP BY 1 HAVING count(*) = 4),
    px0 AS (SELECT vec_id // 4 AS t, vec_id % 4 AS q, unnest(range(0, 64)) AS i, embedding FROM embeddings WHERE vec_id // 4 IN (SELECT t FROM full_t)),
    px AS (SELECT t, (q // 2) * 8 + i // 8 AS pr, (q % 2) * 8 + i % 8 AS pc, embedding[i + 1]::double AS v, embedding[64 - i]::double AS w FROM px0),
    tl AS (SELECT t, t % 256 AS x, (t // 256 + 53 * (t % 256)) % 256 AS y, {cell_sql("t % 256", "(t // 256 + 53 * (t % 256)) % 256", Z)} AS block FROM full_t)"""
GRID = f"""gp AS (SELECT l_orderkey % 64 AS t, l_suppkey % 16 AS pr, l_partkey % 16 AS pc, round(sum(l_quantity))::bigint AS v FROM lineitem GROUP BY ALL),
    gt AS (SELECT DISTINCT t, t % 8 AS x, t // 8 AS y, {cell_sql("t % 8", "t // 8", GZ)} AS block FROM gp)"""
TIMES = """mp AS (SELECT l_orderkey % 64 AS t, date_diff('day', DATE '1992-01-01', date_trunc('month', l_shipdate)::date)::double AS time_cf, l_suppkey % 16 AS pr, l_partkey % 16 AS pc, round(sum(l_quantity))::bigint AS v FROM lineitem GROUP BY ALL)"""
STATS_SQL = f"count(*) AS n, {q('sum(v)')} AS total, {q('avg(v)')} AS mean, {q('min(v)')} AS low, {q('max(v)')} AS high, {q('stddev_pop(v)')} AS sd"


def stats_of(s: str = "s") -> list[Column]:
    c = lambda n: F.col(f"{s}.{n}")
    return [c("count").alias("n"), r(c("sum")).alias("total"), r(c("mean")).alias("mean"), r(c("min")).alias("low"), r(c("max")).alias("high"), r(c("stddev")).alias("sd")]


def rounded_stats(df: DataFrame, *by: str) -> DataFrame:
    return df.select(*by, F.col("count").alias("n"), r("sum").alias("total"), r("mean").alias("mean"), r("min").alias("low"), r("max").alias("high"), r("stddev").alias("sd"))


# Cells and tiles.


@query(f"WITH {POINTS} SELECT event_id, {cell_sql(x_sql('lon', 10), y_sql('lat', 10), 10)} AS block FROM points")
def cell_from_lonlat(spark, d):
    return fx.points(spark, d).select("event_id", merc.point_to_cell(F.col("lon"), F.col("lat"), 10).alias("block"))


@query("SELECT event_id, (event_id * 7919) % 4096 AS x, (event_id * 104729) % 4096 AS y, 12 AS z, true AS valid FROM events")
def cell_roundtrip(spark, d):
    e = F.col("event_id")
    c = fx.table(spark, d, "events").select("event_id", cells.tile_to_cell(e * 7919 % 4096, e * 104729 % 4096, 12).alias("c"))
    t = c.select("event_id", cells.cell_to_tile(F.col("c")).alias("t"), cells.is_cell(F.col("c")).alias("valid"))
    return t.select("event_id", "t.x", "t.y", "t.z", "valid")


@query(f"WITH {POINTS}, c AS (" + " UNION ALL ".join(f"SELECT event_id, {z} AS z, {cell_sql(x_sql('lon', z), y_sql('lat', z), z)} AS block FROM points WHERE event_id % 5 = {i}" for i, z in enumerate((0, 3, 7, 12, 15))) + ") SELECT z AS zoom, count(*) AS n, min(block) AS first, max(block) AS last FROM c GROUP BY z")
def cell_resolution(spark, d):
    z = F.element_at(F.array(*map(F.lit, (0, 3, 7, 12, 15))), (F.col("event_id") % 5 + 1).cast("int"))
    c = fx.points(spark, d).select(merc.point_to_cell(F.col("lon"), F.col("lat"), z).alias("block"))
    return c.groupBy(cells.resolution(F.col("block")).alias("zoom")).agg(F.count("*").alias("n"), F.min("block").alias("first"), F.max("block").alias("last"))


@query(f"WITH {POINTS} SELECT {cell_sql(x_sql('lon', 5), y_sql('lat', 5), 5)} AS block, count(*) AS n, {q('sum(value)', 2)} AS total FROM points GROUP BY 1")
def cell_parent(spark, d):
    c = fx.points(spark, d).withColumn("c", merc.point_to_cell(F.col("lon"), F.col("lat"), 11))
    return c.groupBy(cells.parent(F.col("c"), 5).alias("block")).agg(F.count("*").alias("n"), r(F.sum("value"), 2).alias("total"))


@query(f"WITH {POINTS} SELECT {cell_sql(x_sql('lon', 2), y_sql('lat', 2), 2)} AS block, min({cell_sql(x_sql('lon', 9), y_sql('lat', 9), 9)}) AS first, max({cell_sql(x_sql('lon', 9), y_sql('lat', 9), 9)}) AS last, true AS within FROM points GROUP BY 1")
def cell_children_range(spark, d):
    c = fx.points(spark, d).select(merc.point_to_cell(F.col("lon"), F.col("lat"), 2).alias("block"), merc.point_to_cell(F.col("lon"), F.col("lat"), 9).alias("c"))
    a, b = cells.descendants(F.col("block"), 9)
    return c.withColumn("w", F.col("c").between(a, b)).groupBy("block").agg(F.min("c").alias("first"), F.max("c").alias("last"), F.min("w").alias("within"))


@query(f"WITH {POINTS}, t AS (SELECT DISTINCT {x_sql('lon', 6)} AS x, {y_sql('lat', 6)} AS y FROM points) SELECT x, y, {q('x / 64.0 * 360 - 180', 6)} AS west, {q(lat_sql('y + 1', 6), 6)} AS south, {q('(x + 1) / 64.0 * 360 - 180', 6)} AS east, {q(lat_sql('y', 6), 6)} AS north, {q(f'x * ({merc.CIRCLE!r} / 64) - {merc.CIRCLE!r} / 2', 3)} AS metres_left, {q(f'{merc.CIRCLE!r} / 2 - y * ({merc.CIRCLE!r} / 64)', 3)} AS metres_top FROM t")
def tile_bounds(spark, d):
    t = fx.points(spark, d).select(merc.tile_x(F.col("lon"), 6).alias("x"), merc.tile_y(F.col("lat"), 6).alias("y")).distinct()
    b = t.select("x", "y", merc.bounds(F.col("x"), F.col("y"), 6).alias("b"), merc.metre_bounds(F.col("x"), F.col("y"), 6).alias("m"))
    return b.select("x", "y", *(r(F.col(f"b.{c}"), 6).alias(c) for c in ("west", "south", "east", "north")), r(F.col("m.left"), 3).alias("metres_left"), r(F.col("m.top"), 3).alias("metres_top"))


@query(f"WITH b AS (SELECT n_nationkey AS k, -170.0 + n_nationkey * 12.3 AS w, -60.0 + n_nationkey * 2.7 AS s, -160.5 + n_nationkey * 12.3 AS e, -52.0 + n_nationkey * 2.7 AS n FROM nation), g AS (SELECT k, unnest(range({x_sql('w', 7)}, {x_sql('e - 1e-11', 7)} + 1)) AS x, {y_sql('n', 7)} AS y0, {y_sql('s + 1e-11', 7)} AS y1 FROM b) SELECT k, x, unnest(range(y0, y1 + 1)) AS y FROM g")
def bbox_tiles(spark, d):
    k = F.col("n_nationkey")
    t = fx.table(spark, d, "nation").select(k.alias("k"), merc.bbox_tiles(-170.0 + k * 12.3, -60.0 + k * 2.7, -160.5 + k * 12.3, -52.0 + k * 2.7, 7).alias("t"))
    return t.select("k", F.explode("t").alias("t")).select("k", "t.x", "t.y")


@query(f"SELECT p_partkey, ceil(log2({merc.CIRCLE!r} / 256 / p_retailprice))::int AS upper, floor(log2({merc.CIRCLE!r} / 256 / p_retailprice))::int AS lower, round_even(log2({merc.CIRCLE!r} / 256 / p_retailprice), 0)::int AS auto FROM part")
def find_zoom(spark, d):
    p = F.col("p_retailprice")
    return fx.table(spark, d, "part").select("p_partkey", *(merc.zoom_for(p, s, 8).alias(s) for s in ("upper", "lower", "auto")))


@query("SELECT p_partkey, greatest(0, least(12, 12 - round_even(log2(sqrt((p_size * 256.0) ** 2 + (p_size * 128.0) ** 2) / 128), 0)))::int AS least_zoom FROM part")
def find_minzoom(spark, d):
    s = F.col("p_size")
    return fx.table(spark, d, "part").select("p_partkey", merc.least_zoom(s * 256.0, s * 128.0, F.lit(12)).alias("least_zoom"))


@query(f"SELECT p_partkey, greatest(0, least(18, ceil(log2({merc.CIRCLE!r} / 256 / (p_retailprice * 1000 / (p_size * 100.0))))))::int AS zoom, greatest(3, least(9, p_size % 15))::int AS clamped FROM part")
def service_zoom(spark, d):
    t = merc.target_zoom(F.col("p_retailprice") * 1000, F.col("p_size") * 100.0, 8)
    return fx.table(spark, d, "part").select("p_partkey", t.alias("zoom"), merc.clamped_zoom(F.col("p_size") % 15, 3, 9).cast("int").alias("clamped"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'EPSG:3857' WHEN n_nationkey % 4 = 1 THEN 'EPSG:3785' WHEN n_nationkey % 4 = 2 THEN 'EPSG:' || (4000 + n_nationkey) ELSE 'EPSG:4326' END AS crs, n_nationkey % 4 = 0 AS mercator, '/vsigs/' || n_name AS virtual, 'gs://' || n_name AS bucket FROM nation")
def reference_systems(spark, d):
    k = F.col("n_nationkey")
    wkid = F.when(k % 4 == 0, 102100).when(k % 4 == 1, 102113).when(k % 4 == 2, 4000 + k)
    crs = merc.crs_name(wkid, F.lit(None).cast("string"))
    path = F.concat(F.lit("gs://"), F.col("n_name"))
    return fx.table(spark, d, "nation").select("n_nationkey", crs.alias("crs"), merc.is_web_mercator(crs).alias("mercator"), merc.bucket_to_virtual(path).alias("virtual"), merc.virtual_to_bucket(merc.bucket_to_virtual(path)).alias("bucket"))


@query(f"SELECT p_partkey, {q(f'{merc.CIRCLE!r} / 256 / (1::bigint << (p_size % 20))', 6)} AS unit, {q('sqrt((p_size * 30.0) ** 2 + (p_size * 40.0) ** 2) / sqrt(p_size ** 2 + p_size ** 2)', 6)} AS native, CASE WHEN abs(2 - p_size / 10.0) <= 0.1 * (p_size / 10.0) THEN 0 WHEN abs(4 - p_size / 10.0) <= 0.1 * (p_size / 10.0) THEN 1 END AS overview FROM part")
def raster_geometry(spark, d):
    s = F.col("p_size").cast("double")
    res = merc.native_resolution(s, s, F.lit(0.0), F.lit(0.0), s * 30, s * 40)
    return fx.table(spark, d, "part").select("p_partkey", r(F.get(merc.export_transform(F.col("p_size") % 20), F.lit(0)), 6).alias("unit"), r(res, 6).alias("native"), merc.matching_overview(F.array(F.lit(2.0), F.lit(4.0)), s / 10).alias("overview"))


@query(f"WITH {POINTS} SELECT {cell_sql(x_sql('lon', 9), y_sql('lat', 9), 9)} AS block, count(*) AS n FROM points GROUP BY 1")
def sql_functions(spark, d):
    names.register(spark)
    fx.points(spark, d).createOrReplaceTempView("_points")
    return spark.sql("SELECT cell_from_tile(cell_x(c), cell_y(c), cell_resolution(c)) AS block, count(*) AS n FROM (SELECT cell_parent(cell_from_point(lon, lat, 13), 9) AS c FROM _points) GROUP BY 1")


@query(f"WITH {FULL} SELECT block, count(*) AS n, {q('avg(v)')} AS mean, {q('max(v) FILTER (pr = 2 AND pc = 3)')} AS pixel, {q('min((v - w) / (v + w)) FILTER (v + w <> 0)', 2)} AS low FROM px JOIN tl USING (t) GROUP BY block")
def sql_raster_functions(spark, d):
    names.register(spark, {"demo": ("float32", None, SIZE)})
    fx.float_tiles(spark, d).createOrReplaceTempView("_tiles")
    return spark.sql("""SELECT block, s.count AS n, round(s.mean, 4) + 0.0D AS mean, round(pixel, 4) + 0.0D AS pixel, round(array_min(filter(apart, v -> not isnan(v))), 2) + 0.0D AS low FROM (
        SELECT block, raster_stats_demo(band_1) AS s, raster_value_demo(band_1, 3, 2) AS pixel, raster_pixels_doubles(raster_difference_demo(band_1, band_2)) AS apart FROM _tiles)""")


# Filters on cells.


@query(f"WITH {POINTS}, c AS (" + " UNION ALL ".join(f"SELECT {z} AS zoom, {cell_sql(x_sql('lon', z), y_sql('lat', z), z)} AS block FROM points" for z in range(3, 8)) + ") SELECT zoom, count(DISTINCT block) AS tiles FROM c GROUP BY zoom")
def zoom_distribution(spark, d):
    return layout.zoom_counts(_point_tiles(spark, d))


def _point_tiles(spark, d) -> DataFrame:
    """A pyramid of empty tiles under the points, zoom 3 to 7."""
    c = fx.points(spark, d).select(F.explode(F.transform(F.sequence(F.lit(3), F.lit(7)), lambda z: merc.point_to_cell(F.col("lon"), F.col("lat"), z))).alias("block"))
    return c.distinct()


@query(f"WITH {POINTS} SELECT DISTINCT {cell_sql(x_sql('lon', 5), y_sql('lat', 5), 5)} AS block FROM points")
def zoom_range_filter(spark, d):
    return _point_tiles(spark, d).where(in_zoom(F.col("block"), 5))


@query(f"WITH {FULL} SELECT block, {STATS_SQL} FROM px JOIN tl USING (t) WHERE x = {merc.tile_at(-61.5, -9.0, Z)[0]} AND y = (53 * x) % 256 GROUP BY block")
def point_lookup(spark, d):
    tiles = tables.read_table(spark, _written_floats(spark, d))
    x = merc.tile_at(-61.5, -9.0, Z)[0]
    return tiles.where(F.col("block") == cells.cell_of(x, 53 * x % 256, Z)).select("block", st.summary_udf("float32")("band_1").alias("s")).select("block", *stats_of())


# Statistics.


@query(f"WITH {FULL} SELECT block, {STATS_SQL} FROM px JOIN tl USING (t) GROUP BY block")
def tile_summary_stats(spark, d):
    return fx.float_tiles(spark, d).select("block", st.summary_udf("float32")("band_1").alias("s")).select("block", *stats_of())


@query(f"WITH {FULL}, s AS (SELECT block, {q('avg(v)')} AS mean, {q('max(v)')} AS high, count(*) AS n FROM px JOIN tl USING (t) GROUP BY block) SELECT * FROM s ORDER BY mean, block LIMIT 20")
def top20_flattest(spark, d):
    s = fx.float_tiles(spark, d).select("block", st.summary_udf("float32")("band_1").alias("s"))
    return s.select("block", r("s.mean").alias("mean"), r("s.max").alias("high"), F.col("s.count").alias("n")).orderBy("mean", "block").limit(20)


@query(f"WITH {FULL} SELECT block, {STATS_SQL} FROM px JOIN tl USING (t) GROUP BY block")
def tile_stats_expressions(spark, d):
    v = fx.float_tiles(spark, d).select("block", px.decode_udf("float32")("band_1").alias("v"))
    return v.select("block", st.array_summary(F.col("v")).alias("s")).select("block", *stats_of())


@query(f"WITH {FULL} SELECT block, {STATS_SQL} FROM px JOIN tl USING (t) WHERE v >= 0 GROUP BY block")
def nodata_stats(spark, d):
    s = fx.float_tiles(spark, d, NODATA).select("block", st.summary_udf("float32", NODATA)("band_1").alias("s"))
    return s.where("s.count is not null").select("block", *stats_of())


def _stored(spark, d) -> DataFrame:
    """The tiles of a written table of one zoom, with their stored statistics."""
    return tables.read_table(spark, _written_floats(spark, d))


@query(f"WITH {FULL} SELECT {STATS_SQL} FROM px")
def tile_stats_merge_global(spark, d):
    return rounded_stats(_stored(spark, d).agg(*st.merged_of_columns("band_1")))


@query(f"WITH {FULL}, s AS (SELECT t, avg(v) AS m, max(v) AS h, count(*) AS n FROM px GROUP BY t) SELECT {q('avg(m)')} AS mean_of_means, {q('max(h)')} AS high, sum(n)::bigint AS n FROM s")
def tile_stats_udf_free(spark, d):
    return _stored(spark, d).agg(r(F.avg("band_1_mean")).alias("mean_of_means"), r(F.max("band_1_max")).alias("high"), F.sum("band_1_count").alias("n"))


@query(f"WITH {FULL} SELECT block, {q('100.0 * count(*) FILTER (v >= 0) / count(*)')} AS valid_percent FROM px JOIN tl USING (t) GROUP BY block")
def valid_percent(spark, d):
    s = fx.float_tiles(spark, d, NODATA).select("block", st.summary_udf("float32", NODATA)("band_1").alias("s"))
    return s.select("block", r(st.valid_percent(F.coalesce("s.count", F.lit(0)), F.lit(SIZE * SIZE))).alias("valid_percent"))


@query(f"WITH {FULL}, k AS (SELECT t, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM px GROUP BY t) SELECT block, {STATS_SQL} FROM px JOIN k USING (t) JOIN tl USING (t) WHERE v BETWEEN a - 10 * (b - a) AND b + 10 * (b - a) GROUP BY block")
def outlier_filtered_stats(spark, d):
    s = fx.float_tiles(spark, d).select("block", st.summary_udf("float32", outliers=True)("band_1").alias("s"))
    return s.select("block", *stats_of())


@query(f"WITH {FULL}, s AS (SELECT t, count(*) AS n, sum(v) AS total FROM px GROUP BY t) SELECT block, n * 16 AS count, {q('total * 16')} AS sum FROM s JOIN tl USING (t)")
def scaled_stats(spark, d):
    n, s = st.scaled(F.col("band_1_count"), F.col("band_1_sum"), 2)
    return _stored(spark, d).select("block", n, r(s).alias("sum"))


@query(f"WITH {FULL}, s AS (SELECT t, max(v) AS h FROM px GROUP BY t) SELECT block, {q('h')} AS high FROM s JOIN tl USING (t) WHERE h < 2.5")
def stats_filter(spark, d):
    return _stored(spark, d).where(F.col("band_1_max") < 2.5).select("block", r("band_1_max").alias("high"))


@query(f"WITH {FULL}, s AS (SELECT t, avg(v) AS m FROM px GROUP BY t) SELECT count(*) FILTER (m < 0) AS flat, count(*) AS tiles, {q('100.0 * count(*) FILTER (m < 0) / count(*)')} AS percent FROM s")
def suitability_scan(spark, d):
    flat = F.count_if(F.col("band_1_mean") < 0)
    return _stored(spark, d).agg(flat.alias("flat"), F.count("*").alias("tiles"), r(100.0 * flat / F.count("*")).alias("percent"))


@query(f"WITH {FULL}, b AS (SELECT least(9, floor((v + 4) / 8 * 10))::int AS bucket FROM px WHERE v BETWEEN -4 AND 4) SELECT bucket, count(*) AS n FROM b GROUP BY bucket")
def pixel_histogram(spark, d):
    h = fx.float_tiles(spark, d).select(F.posexplode(st.histogram_udf("float32", -4.0, 4.0, 10)("band_1")).alias("bucket", "c"))
    return h.groupBy("bucket").agg(F.sum("c").alias("n")).where("n > 0")


# Points and areas.


def _on_tiles(spark, d) -> DataFrame:
    """Points moved near tiles: one to each event, with about half of the tiles hit."""
    e = F.col("event_id")
    x = e % 256
    y = (53 * x) % 256
    c = fx.table(spark, d, "events").select("event_id", "value", ((x + (e % 16 + 0.5) / 16) / 256 * 360 - 180).alias("lon"), (y + (F.floor(e / 16) % 16 + 0.5) / 16).alias("_fy"))
    return c.withColumn("lat", F.degrees(F.atan(F.sinh(3.141592653589793 * (1 - 2 * F.col("_fy") / 256))))).drop("_fy").withColumnRenamed("value", "measured")


ON_TILES = "pt AS (SELECT event_id, value AS measured, event_id % 256 AS t, event_id % 16 AS pc, event_id // 16 % 16 AS pr FROM events)"


@query(f"WITH {FULL}, {ON_TILES} SELECT event_id, {q('v')} AS value FROM pt LEFT JOIN px USING (t, pc, pr)")
def raster_value_at_points(spark, d):
    v = zonal.values_at(_on_tiles(spark, d), fx.float_tiles(spark, d), "band_1", "float32", Z, SIZE)
    return v.select("event_id", r("value").alias("value"))


@query(f"WITH {FULL}, {ON_TILES} SELECT block, count(*) AS n, {q('sum(measured)', 2)} AS measured FROM pt JOIN tl USING (t) GROUP BY block")
def point_tile_join(spark, d):
    p = _on_tiles(spark, d).withColumn("block", merc.point_to_cell(F.col("lon"), F.col("lat"), Z))
    return p.join(fx.float_tiles(spark, d).select("block"), "block").groupBy("block").agg(F.count("*").alias("n"), r(F.sum("measured"), 2).alias("measured"))


@query(f"WITH {FULL}, {ON_TILES} SELECT event_id, {q('v')} AS value FROM pt JOIN px USING (t, pc, pr)")
def raster_value_zoom_clamp(spark, d):
    v = zonal.table_values(spark, _written_floats(spark, d), _on_tiles(spark, d), "band_1", 14)
    return v.where("value is not null").select("event_id", r("value").alias("value"))


#: An area whose border falls on no tile's border, and the pixels within by SQL.
WKT = "POLYGON((-170.3 -70.2, 150.7 -70.2, 150.7 65.1, -170.3 65.1, -170.3 -70.2))"
CENTRE = f"""ce AS (SELECT px.t, x, y, block, pr, pc, v, (x * 16 + pc + 0.5) / 4096.0 * 360 - 180 AS lon, {lat_sql("y * 16 + pr + 0.5", 12)} AS lat FROM px JOIN tl USING (t))"""
INSIDE = "lon > -170.3 AND lon < 150.7 AND lat > -70.2 AND lat < 65.1"
TILE_BOX = f"bx AS (SELECT *, x / 256.0 * 360 - 180 AS w, (x + 1) / 256.0 * 360 - 180 AS e, {lat_sql('y + 1', 8)} AS s, {lat_sql('y', 8)} AS n FROM tl)"


@query(f"WITH {FULL}, {CENTRE} SELECT {STATS_SQL} FROM ce WHERE {INSIDE}")
def region_stats_bbox(spark, d):
    return rounded_stats(zonal.region_stats(fx.float_tiles(spark, d), "band_1", "float32", parse_wkt(WKT), Z, SIZE))


@query(f"WITH {FULL}, {CENTRE} SELECT {STATS_SQL} FROM ce WHERE {INSIDE}")
def region_stats_stored(spark, d):
    return rounded_stats(zonal.region_stats(_stored(spark, d), "band_1", "float32", parse_wkt(WKT), Z, SIZE, stored=True))


@query(f"WITH {FULL}, {CENTRE} SELECT {STATS_SQL} FROM ce WHERE lat < 60 AND lat > -60 AND ((lon > -150 AND lon < 0 AND lat < lon * 0.4 + 60) OR (lon >= 0 AND lon < 150 AND lat < 60 - lon * 0.4))")
def region_stats_polygon(spark, d):
    area = parse_wkt("POLYGON((-150 -60, 150 -60, 150 0, 0 60, -150 0, -150 -60))")
    return rounded_stats(zonal.region_stats(fx.float_tiles(spark, d), "band_1", "float32", area, Z, SIZE))


def _cells_in(spark, d, mode: str) -> DataFrame:
    return fx.float_tiles(spark, d).where(intersects(F.col("block"), parse_wkt(WKT), Z, mode)).select("block")


@query(f"WITH {FULL}, {TILE_BOX} SELECT block FROM bx WHERE e > -170.3 AND w < 150.7 AND n > -70.2 AND s < 65.1")
def region_cells_intersects(spark, d):
    return _cells_in(spark, d, "intersects")


@query(f"WITH {FULL}, {TILE_BOX} SELECT block FROM bx WHERE w >= -170.3 AND e <= 150.7 AND s >= -70.2 AND n <= 65.1")
def region_cells_contains(spark, d):
    return _cells_in(spark, d, "contains")


@query(f"WITH {FULL} SELECT block FROM tl WHERE (x + 0.5) / 256.0 * 360 - 180 BETWEEN -170.3 AND 150.7 AND {lat_sql('y + 0.5', 8)} BETWEEN -70.2 AND 65.1")
def region_cells_center(spark, d):
    return _cells_in(spark, d, "center")


@query(f"WITH {FULL}, {CENTRE} SELECT block, pc::int AS px, pr::int AS py, {q('v')} AS value FROM ce WHERE lon > -20.4 AND lon < 41.3 AND lat > -31.7 AND lat < 52.9")
def clip_pixels(spark, d):
    c = zonal.clip(fx.float_tiles(spark, d), "band_1", "float32", box_area(-20.4, -31.7, 41.3, 52.9), Z, SIZE)
    return c.select("block", "px", "py", r("value").alias("value"))


@query(f"WITH {FULL}, {CENTRE} SELECT r_name AS zone, {STATS_SQL} FROM ce JOIN region ON lon >= -180 + 72 * r_regionkey AND lon < -108 + 72 * r_regionkey WHERE lat > -60 AND lat < 60 GROUP BY r_name")
def zonal_stats_by_region(spark, d):
    return rounded_stats(zonal.zonal_stats(fx.float_tiles(spark, d), fx.zone_boxes(spark, d), "band_1", "float32", Z, SIZE), "zone")


# Bands.


@query(f"WITH {FULL}, k AS (SELECT t, (v - w) / (v + w) AS v FROM px WHERE v + w <> 0) SELECT block, count(*) AS n, {q('min(v)', 2)} AS low, {q('max(v)', 2)} AS high FROM k JOIN tl USING (t) GROUP BY block")
def normalized_difference(spark, d):
    nd = px.combine_udf(px.normalized_difference, "float32")("band_1", "band_2")
    s = fx.float_tiles(spark, d).select("block", st.summary_udf("float64")(nd).alias("s"))
    return s.select("block", F.col("s.count").alias("n"), r("s.min", 2).alias("low"), r("s.max", 2).alias("high"))


@query(f"WITH {FULL}, k AS (SELECT t, (v - w) / (v + w) AS v FROM px WHERE v >= 0 AND w >= 0 AND v + w <> 0) SELECT block, count(*) AS n, {q('avg(v)')} AS mean, {q('stddev_pop(v)')} AS sd FROM k JOIN tl USING (t) GROUP BY block")
def normalized_difference_stats(spark, d):
    nd = px.combine_udf(px.normalized_difference, "float32", nodata=NODATA)("band_1", "band_2")
    s = fx.float_tiles(spark, d, NODATA).select("block", st.summary_udf("float64")(nd).alias("s")).where("s.count is not null")
    return s.select("block", F.col("s.count").alias("n"), r("s.mean").alias("mean"), r("s.stddev").alias("sd"))


@query(f"WITH {FULL} SELECT block, {q('sum(v * 2.5 + 10)')} AS total, {q('min(v * 2.5 + 10)')} AS low FROM px JOIN tl USING (t) GROUP BY block")
def scale_offset(spark, d):
    v = fx.float_tiles(spark, d).select("block", px.decode_udf("float32", scale=2.5, offset=10.0)("band_1").alias("v"))
    s = v.select("block", st.array_summary(F.col("v")).alias("s"))
    return s.select("block", r("s.sum").alias("total"), r("s.min").alias("low"))


@query(f"WITH {FULL} SELECT block, {q('sum(v)')} AS one, {q('sum(w)')} AS two, true AS same FROM px JOIN tl USING (t) GROUP BY block")
def interleave_roundtrip(spark, d):
    t = fx.float_tiles(spark, d).withColumn("pixels", px.interleave_udf("float32")(F.array("band_1", "band_2")))
    t = t.select("block", "band_1", *(px.band_of_udf("float32", 2, i)("pixels").alias(f"b{i}") for i in (1, 2)))
    s = st.summary_udf("float32")
    return t.select("block", r(s("b1")["sum"]).alias("one"), r(s("b2")["sum"]).alias("two"), (F.col("b1") == F.col("band_1")).alias("same"))


@query(f"WITH {FULL} SELECT block, {q('sum(v - w)')} AS apart FROM px JOIN tl USING (t) GROUP BY block")
def raster_raster_join(spark, d):
    a = fx.float_tiles(spark, d).select("block", "band_1")
    b = fx.float_tiles(spark, d).select("block", F.col("band_2").alias("band_1"))
    j = zonal.raster_join(a, b)
    minus = px.combine_udf(lambda x, y: x - y, "float32")("band_1", "band_1_b")
    return j.select("block", r(st.summary_udf("float64")(minus)["sum"]).alias("apart"))


@query(f"WITH {FULL} SELECT block, count(*) FILTER (w >= 0) AS kept FROM px JOIN tl USING (t) GROUP BY block")
def masked_band(spark, d):
    cut = px.combine_udf(lambda a, b: px.masked_where(a, (b >= 0).astype(float), NODATA), "float32")("band_1", "band_2")
    return fx.float_tiles(spark, d).select("block", F.coalesce(st.summary_udf("float64", NODATA)(cut)["count"], F.lit(0)).alias("kept"))


@query(f"WITH {GRID} SELECT block, count(*) AS n, sum(v)::double AS total, true AS same FROM gp JOIN gt USING (t) GROUP BY block")
def integer_codec_roundtrip(spark, d):
    t = fx.grid_tiles(spark, d)
    again = px.encode_udf("int32")(px.decode_udf("int32")("band_1"))
    s = t.select("block", st.summary_udf("int32", -32768)("band_1").alias("s"), (again == F.col("band_1")).alias("same"))
    return s.select("block", F.col("s.count").alias("n"), F.col("s.sum").alias("total"), "same")


@query(f"WITH {GRID} SELECT block, count(*) < 1 AS empty FROM gp JOIN gt USING (t) GROUP BY block")
def empty_tiles(spark, d):
    return fx.grid_tiles(spark, d).select("block", px.is_empty_udf("int32", -32768)("band_1").alias("empty"))


# Time.

_UNITS = ["minutes since 1980-01-01", "days since 1992-01-01 00:00:00", "hour since 2000-02-29T12:00", "months since 1999-01-31", "years since 2001-06-15 06:30", "seconds since 19700101", "fortnights since 2000-01-01", "days after 2000"]
_PARSED = [("minutes", "1980-01-01 00:00:00"), ("days", "1992-01-01 00:00:00"), ("hours", "2000-02-29 12:00:00"), ("months", "1999-01-31 00:00:00"), ("years", "2001-06-15 06:30:00"), ("seconds", "1970-01-01 00:00:00"), None, None]


def _axes(spark, d) -> DataFrame:
    units = F.element_at(F.array(*map(F.lit, _UNITS)), (F.col("event_id") % 8 + 1).cast("int"))
    return fx.table(spark, d, "events").select("event_id", units.alias("units")).withColumn("p", cftime.parse_units(F.col("units")))


@query("SELECT event_id, CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{p[0]}'" for i, p in enumerate(_PARSED) if p) + " END AS unit, CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{p[1]}'" for i, p in enumerate(_PARSED) if p) + " END AS reference FROM events")
def cf_parse_units(spark, d):
    return _axes(spark, d).select("event_id", "p.unit", F.date_format("p.reference", "yyyy-MM-dd HH:mm:ss").alias("reference"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE 'days since 1992-01-01' END AS units, CASE WHEN event_id % 3 = 2 THEN NULL WHEN event_id % 3 = 0 THEN 'noleap' ELSE 'standard' END AS calendar, CASE WHEN event_id % 3 = 2 THEN NULL ELSE (2 * event_id + 1)::double END AS total, CASE WHEN event_id % 2 = 0 THEN event_id::double END AS band_time FROM events")
def cf_axis(spark, d):
    e = F.col("event_id")
    text = F.concat(F.lit("{"), e, F.lit(", "), e + 1, F.lit("}"))
    unit = F.lit("days since 1992-01-01")
    items = F.when(e % 3 == 0, F.create_map(F.lit("time#units"), unit, F.lit("time#calendar"), F.lit("noleap"), F.lit("NETCDF_DIM_time_VALUES"), text)).when(e % 3 == 1, F.create_map(F.lit("valid_time#units"), unit, F.lit("NETCDF_DIM_time_VALUES"), text)).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    band = F.create_map(F.lit("NETCDF_DIM_time"), F.when(e % 2 == 0, e.cast("string")).otherwise("none"))
    a = fx.table(spark, d, "events").select("event_id", cftime.axis_of(items).alias("a"), cftime.band_time(band).alias("band_time"))
    return a.select("event_id", "a.units", "a.calendar", F.aggregate("a.values", F.lit(0.0), lambda s, v: s + v).alias("total"), "band_time")


@query("""WITH v AS (SELECT event_id, event_id % 8 AS k, (event_id // 8 % 40) AS n FROM events)
    SELECT event_id, strftime(CASE k WHEN 0 THEN TIMESTAMP '1980-01-01' + to_minutes(n) WHEN 1 THEN TIMESTAMP '1992-01-01' + to_days(n::int) WHEN 2 THEN TIMESTAMP '2000-02-29 12:00' + to_hours(n)
        WHEN 3 THEN CASE WHEN day(TIMESTAMP '1999-01-31' + to_months(n::int)) = 31 THEN TIMESTAMP '1999-01-31' + to_months(n::int) END
        WHEN 4 THEN TIMESTAMP '2001-06-15 06:30' + to_years(n::int) WHEN 5 THEN TIMESTAMP '1970-01-01' + to_seconds(n) END, '%Y-%m-%d %H:%M:%S') AS stamp FROM v""")
def cf_to_timestamp(spark, d):
    v = (F.floor(F.col("event_id") / 8) % 40).cast("double")
    t = cftime.to_timestamp(v, F.col("p.unit"), F.col("p.reference"), F.lit("standard"))
    return _axes(spark, d).select("event_id", F.date_format(t, "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@query("""WITH a AS (SELECT k, CASE k % 4 WHEN 0 THEN 'minutes' WHEN 1 THEN 'hours' WHEN 2 THEN 'days' ELSE 'months' END AS unit, CASE k % 4 WHEN 0 THEN 60 WHEN 1 THEN 24 WHEN 2 THEN 31 ELSE 1 END AS step FROM (SELECT n_nationkey AS k FROM nation))
    SELECT k, step::double AS "interval", true AS regular, CASE k % 4 WHEN 0 THEN 'PT1H' WHEN 1 THEN 'P1D' WHEN 2 THEN 'P1M' ELSE 'P1M' END AS duration FROM a""")
def cf_iso_duration(spark, d):
    k = F.col("n_nationkey")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (k % 4 + 1).cast("int"))
    axis = fx.table(spark, d, "nation").select(k.alias("k"), pick("minutes", "hours", "days", "months").alias("unit"), pick(60, 24, 31, 1).alias("step"))
    values = axis.select("k", "unit", F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i * F.col("step")).cast("double"))).alias("v"))
    found = cftime.axis_interval(values, ["k", "unit"], "v")
    return found.select("k", "interval", "regular", F.when(F.col("regular"), cftime.iso_duration(F.col("unit"), F.col("interval"))).alias("duration"))


@query(f"WITH {TIMES}, s AS (SELECT t, time_cf, avg(v) AS m, sum(v) AS total FROM mp GROUP BY ALL) SELECT year(DATE '1992-01-01' + time_cf::int)::int AS year, {q('avg(m)')} AS mean, sum(total)::double AS total, count(*) AS tiles FROM s GROUP BY 1")
def timeseries_by_year(spark, d):
    t = fx.time_tiles(spark, d).select("time_cf", st.summary_udf("int32", -32768)("band_1").alias("s"))
    stamp = cftime.to_timestamp(F.col("time_cf"), F.lit("days"), F.lit("1992-01-01").cast("timestamp_ntz"))
    return t.groupBy(F.year(stamp).alias("year")).agg(r(F.avg("s.mean")).alias("mean"), F.sum("s.sum").alias("total"), F.count("*").alias("tiles"))


@query(f"WITH {FULL} SELECT block, 0.0::double AS time_cf, {q('sum(v)')} AS total FROM px JOIN tl USING (t) GROUP BY block UNION ALL SELECT block, 30.0::double, {q('sum(w)')} FROM px JOIN tl USING (t) GROUP BY block")
def tile_time_unpivot(spark, d):
    t = cftime.band_times(fx.float_tiles(spark, d), ["band_1", "band_2"], [0.0, 30.0], ["block"])
    return t.select("block", "time_cf", r(st.summary_udf("float32")("band_1")["sum"]).alias("total"))


@query(f"WITH {TIMES}, s AS (SELECT DISTINCT t, time_cf FROM mp) SELECT {cell_sql('t % 8', 't // 8', GZ)} AS block, time_cf, row_number() OVER (PARTITION BY t ORDER BY time_cf)::int AS step FROM s")
def sort_block_time(spark, d):
    from pyspark.sql import Window

    path = _folder(spark)
    tables.write_table(fx.time_tiles(spark, d), path, {"bands": []}, group_rows=50, mode="append")
    t = tables.scan(spark, path).where("block <> 0").select("block", "time_cf", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
    return t.select("block", "time_cf", F.row_number().over(Window.partitionBy("block").orderBy("f", "i")).alias("step"))


@query(f"WITH {TIMES} SELECT count(DISTINCT time_cf) AS steps, min(time_cf) AS first, max(time_cf) AS last, 'P1M' AS resolution FROM mp")
def time_metadata(spark, d):
    axis = meta_.time_axis(fx.time_tiles(spark, d).select(F.floor(F.months_between(F.date_add(F.lit("1992-01-01").cast("date"), F.col("time_cf").cast("int")), F.lit("1992-01-01").cast("date"))).cast("double").alias("time_cf")), "months since 1992-01-01")
    days = meta_.time_axis(fx.time_tiles(spark, d), "days since 1992-01-01")
    return spark.createDataFrame([(days["count"], *days["range"], axis["resolution"])], "steps long, first double, last double, resolution string")


# Overviews.

PARENT_PX = f"""pp AS (SELECT gt.t, gt.x // 2 AS x, gt.y // 2 AS y, (gt.y % 2) * 8 + pr // 2 AS pr, (gt.x % 2) * 8 + pc // 2 AS pc, pr % 2 * 2 + pc % 2 AS corner, v FROM gp JOIN gt USING (t))"""


def _overview(how: str):
    def run(spark, d):
        t = fx.grid_tiles(spark, d)
        as_float = px.combine_udf(lambda a, b: a, "int32", "float64", -32768)("band_1", "band_1")
        o = pyramid.overview(t.select("block", as_float.alias("band_1")), ["band_1"], "float64", SIZE, GZ - 1, how)
        s = o.select("block", st.summary_udf("float64")("band_1").alias("s")).where("s.count is not null")
        return s.select("block", F.col("s.count").alias("n"), r("s.sum").alias("total"), r("s.min").alias("low"), r("s.max").alias("high"))

    run.__name__ = f"resample_{how}" if how != "average" else "overview_average"
    return run


for _how, _agg in {"average": "avg(v)", "min": "min(v)", "max": "max(v)", "sum": "sum(v)", "rms": "sqrt(avg(v * v))", "med": "quantile_cont(v, 0.5)", "q1": "quantile_cont(v, 0.25)", "q3": "quantile_cont(v, 0.75)", "near": "max(v) FILTER (corner = 0)"}.items():
    query(f"WITH {GRID}, {PARENT_PX}, o AS (SELECT x, y, pr, pc, ({_agg})::double AS v FROM (SELECT x, y, pr, pc, corner, v::double AS v FROM pp) GROUP BY ALL) SELECT {cell_sql('x', 'y', GZ - 1)} AS block, count(v) AS n, {q('sum(v)')} AS total, {q('min(v)')} AS low, {q('max(v)')} AS high FROM o WHERE v IS NOT NULL GROUP BY x, y")(_overview(_how))
query(f"WITH {GRID}, {PARENT_PX}, c AS (SELECT x, y, pr, pc, v, count(*) AS k FROM pp GROUP BY ALL), o AS (SELECT x, y, pr, pc, arg_min(v, -k * 1000000000 + v)::double AS v FROM c GROUP BY ALL) SELECT {cell_sql('x', 'y', GZ - 1)} AS block, count(*) AS n, {q('sum(v)')} AS total, {q('min(v)')} AS low, {q('max(v)')} AS high FROM o GROUP BY x, y")(_overview("mode"))


@query(f"WITH {GRID}, a AS (" + " UNION ALL ".join(f"SELECT DISTINCT {z} AS zoom, x >> {GZ - z} AS x, y >> {GZ - z} AS y FROM gt" for z in range(GZ + 1)) + ") SELECT zoom, count(*) AS tiles FROM a GROUP BY zoom")
def pyramid_counts(spark, d):
    return pyramid.pyramid_counts(fx.grid_tiles(spark, d).select("block"), 0)


@query(f"WITH {GRID}, g AS (SELECT x * 16 + pc AS c, y * 16 + pr AS r, v FROM gp JOIN gt USING (t)), a AS (" + " UNION ALL ".join(f"SELECT {z} AS zoom, c >> {GZ - z} AS c, r >> {GZ - z} AS r, sum(v) AS v FROM g GROUP BY ALL" for z in range(1, GZ + 1)) + f") SELECT zoom, c >> 4 AS x, r >> 4 AS y, count(*) AS n, sum(v)::double AS total, min(v)::double AS low, max(v)::double AS high FROM a GROUP BY ALL")
def pyramid_tiles(spark, d):
    p = pyramid.pyramid(fx.grid_tiles(spark, d), ["band_1"], "int32", SIZE, GZ, 1, "sum", -32768)
    s = p.select(cells.resolution(F.col("block")).alias("zoom"), cells.cell_x(F.col("block")).alias("x"), cells.cell_y(F.col("block")).alias("y"), st.summary_udf("int32", -32768)("band_1").alias("s"))
    return s.select("zoom", "x", "y", F.col("s.count").alias("n"), F.col("s.sum").alias("total"), F.col("s.min").alias("low"), F.col("s.max").alias("high"))


@query(f"WITH {FULL} SELECT ((max(x) - min(x) + 1) * 16)::bigint AS width, ((max(y) - min(y) + 1) * 16)::bigint AS height, {q('min(x) / 256.0 * 360 - 180')} AS west, {q(lat_sql('max(y) + 1', 8))} AS south, {q('(max(x) + 1) / 256.0 * 360 - 180')} AS east, {q(lat_sql('min(y)', 8))} AS north, count(*) AS blocks FROM tl")
def dataset_dimensions(spark, d):
    s = convert.dimensions(fx.float_tiles(spark, d), Z, SIZE)
    return s.select("width", "height", *(r(c).alias(c) for c in ("west", "south", "east", "north")), "blocks")


# Layout.


@query(f"WITH {POINTS}, c AS (SELECT DISTINCT {x_sql('lon', 7)} AS x, {y_sql('lat', 7)} AS y FROM points) SELECT 'z3_' || (x >> 4) || '_' || (y >> 4) AS part_file, count(*) AS tiles FROM c GROUP BY ALL")
def partition_assign(spark, d):
    t = layout.with_ancestor(_point_tiles(spark, d).where(in_zoom(F.col("block"), 7)), 3)
    return t.groupBy("part_file").agg(F.count("*").alias("tiles"))


@query("""WITH f AS (SELECT p_partkey, 12 AS native, p_size * 100 AS n, p_size * 100 * p_retailprice AS b FROM part), z AS (SELECT p_partkey, n, greatest(0, least(11, round_even(12 - ln(greatest(1.0, 100000 / greatest(1.0, b / n))) / ln(4.0), 0)))::int AS z FROM f)
    SELECT p_partkey, CASE WHEN n / 4.0 ** (12 - z) >= 2 THEN z END AS zoom FROM z""")
def auto_partition_zoom(spark, d):
    n = F.col("p_size") * 100
    return fx.table(spark, d, "part").select("p_partkey", layout.partition_zoom_of(12, n, n * F.col("p_retailprice"), 100_000).alias("zoom"))


@query(f"WITH {GRID}, s AS (SELECT x >> 2 AS a, y >> 2 AS b, count(*) * 1024 AS bytes FROM gt GROUP BY ALL) SELECT count(*) AS files, min(bytes)::bigint AS least, max(bytes)::bigint AS most, avg(bytes) AS mean FROM s")
def partition_sizes(spark, d):
    plain = px.encode_udf("int32", "none")(px.decode_udf("int32")("band_1"))
    return layout.size_summary(layout.partition_summary(fx.grid_tiles(spark, d).select("block", plain.alias("band_1")), ["band_1"], 1))


@query(f"WITH {GRID}, a AS (" + " UNION ALL ".join(f"SELECT DISTINCT {z} AS zoom, x >> {GZ - z} AS x, y >> {GZ - z} AS y FROM gt" for z in range(1, GZ + 1)) + ") SELECT zoom, count(*) AS tiles, 1::bigint AS metadata_rows FROM a GROUP BY zoom")
def split_zoom_counts(spark, d):
    source, to = _written(spark, d), _folder(spark)
    layout.split_by_zoom(spark, source, to)
    rows = spark.read.parquet(to)
    return rows.groupBy("zoom").agg(F.count_if(F.col("block") != 0).alias("tiles"), F.count_if(F.col("block") == 0).alias("metadata_rows"))


@query(f"WITH {GRID} SELECT 'z1_' || (x >> 2) || '_' || (y >> 2) AS part_file, count(*) AS tiles, 1::bigint AS metadata_rows FROM gt GROUP BY ALL")
def partition_files(spark, d):
    source, to = _written(spark, d), _folder(spark)
    layout.partition(spark, source, to, 1)
    rows = spark.read.parquet(to)
    return rows.groupBy("part_file").agg(F.count_if(F.col("block") != 0).alias("tiles"), F.count_if(F.col("block") == 0).alias("metadata_rows"))


@query(f"WITH {FULL}, z AS (SELECT block, 1024 AS size, sum(1024) OVER (ORDER BY block) - 1024 AS before FROM tl) SELECT (before // 10000)::bigint AS file, count(*) AS tiles, sum(size)::bigint AS bytes FROM z GROUP BY 1")
def file_split_sizes(spark, d):
    raw = px.combine_udf(lambda a, b: a, "float32", "float32")("band_1", "band_1")
    t = fx.float_tiles(spark, d).select("block", px.decode_udf("float32")(raw).alias("v"))
    return layout.file_splits(t.select("block", px.encode_udf("float32", "none")("v").alias("band_1")), ["band_1"], 10_000)


# Tables on disk.

_WRITTEN: dict[tuple[int, str], str] = {}


def _folder(spark: SparkSession) -> str:
    """A new folder for a table, under the shared folder of the session."""
    return new_folder(spark) + "/t"


def _written(spark: SparkSession, d: str) -> str:
    """The grid's table with overviews from zoom 1 on, written once a session and directory."""
    key = (id(spark), d)
    if key not in _WRITTEN:
        path = _folder(spark)
        convert.build_table(spark, fx.grid_tiles(spark, d), path, "int32", GZ, SIZE, least_zoom=1, resampling="sum", nodata=-32768)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def _written_floats(spark: SparkSession, d: str) -> str:
    """The float tiles' table of one zoom with stored statistics, written once a session and directory."""
    key = (id(spark), f"{d}#floats")
    if key not in _WRITTEN:
        path = _folder(spark)
        convert.build_table(spark, fx.float_tiles(spark, d).drop("t"), path, "float32", Z, SIZE, overviews=convert.Overviews.NONE, group_rows=50)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def prepare(spark: SparkSession, d: str) -> None:
    """Write the tables that queries read, so that a bench measures the reads."""
    _written(spark, d)
    _written_floats(spark, d)


@query(f"WITH {GRID} SELECT 1 AS min_zoom, 3 AS max_zoom, 7 AS pixel_zoom, 16 AS block_width, (SELECT count(*) FROM gt)::int AS num_blocks, 'EPSG:3857' AS crs, 'gzip' AS compression, 'band_1' AS band, 'int32' AS type, {q('min(v)')} AS low, {q('max(v)')} AS high, {q('avg(v)')} AS mean, {q('stddev_pop(v)')} AS sd FROM gp")
def metadata_row(spark, d):
    text = tables.scan(spark, _written(spark, d)).where("block = 0").select(F.from_json("metadata", "crs string, compression string, tiling struct<min_zoom:int,max_zoom:int,pixel_zoom:int,block_width:int,num_blocks:int>, bands array<struct<name:string,type:string,STATISTICS_MINIMUM:double,STATISTICS_MAXIMUM:double,STATISTICS_MEAN:double,STATISTICS_STDDEV:double>>").alias("m"))
    b = F.col("m.bands")[0]
    return text.select("m.tiling.*", "m.crs", "m.compression", b["name"].alias("band"), b["type"].alias("type"), r(b["STATISTICS_MINIMUM"]).alias("low"), r(b["STATISTICS_MAXIMUM"]).alias("high"), r(b["STATISTICS_MEAN"]).alias("mean"), r(b["STATISTICS_STDDEV"]).alias("sd"))


@query(f"WITH {GRID} SELECT block, count(*) AS n, sum(v)::double AS total FROM gp JOIN gt USING (t) WHERE x = {merc.tile_at(30.0, 20.0, GZ)[0]} AND y = {merc.tile_at(30.0, 20.0, GZ)[1]} GROUP BY block")
def read_at_point(spark, d):
    t = tables.read_at(spark, _written(spark, d), 30.0, 20.0)
    return t.select("block", F.col("band_1_count").alias("n"), F.col("band_1_sum").alias("total"))


@query(f"WITH {GRID} SELECT block, count(*) AS n FROM gp JOIN gt USING (t) WHERE x BETWEEN {merc.tile_at(-100, 0, GZ)[0]} AND {merc.tile_at(100, 0, GZ)[0]} AND y BETWEEN {merc.tile_at(0, 50, GZ)[1]} AND {merc.tile_at(0, -50, GZ)[1]} GROUP BY block")
def read_region(spark, d):
    t = tables.read_region(spark, _written(spark, d), box_area(-100, -50, 100, 50))
    return t.select("block", F.col("band_1_count").alias("n"))


@query(f"WITH {GRID}, a AS (" + " UNION ALL ".join(f"SELECT DISTINCT {z} AS zoom, x >> {GZ - z} AS x, y >> {GZ - z} AS y FROM gt" for z in range(1, GZ + 1)) + ") SELECT zoom, count(*) AS tiles, count(*) AS valid, 100.0::double AS share FROM a GROUP BY zoom")
def pyramid_check(spark, d):
    t = tables.read_table(spark, _written(spark, d)).withColumn("_empty", px.is_empty_udf("int32", -32768)("band_1"))
    return checks.pyramid_report(t, 1, GZ, F.col("_empty"))


@query("SELECT 0::bigint AS errors, 0::bigint AS warnings")
def table_validation(spark, d):
    f = checks.validate(spark, _written(spark, d))
    return f.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


@query("SELECT * FROM (VALUES ('error', 'schema', 'there is no band'), ('error', 'schema', 'band_1 is string, not binary')) v(severity, \"check\", message)")
def schema_check(spark, d):
    bad = fx.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("block"), F.col("n_name").alias("metadata"), F.col("n_name").alias("band_1"))
    return spark.createDataFrame(checks.schema_findings(bad), checks.FINDINGS)


@query("SELECT * FROM (VALUES ('error', 'bands', 'band_2 is in the metadata, not in the table')) v(severity, \"check\", message)")
def band_data_check(spark, d):
    path = _written(spark, d)
    meta = tables.read_metadata(spark, path)
    meta["bands"].append(meta_.Band("band_2", "int32").document())
    return spark.createDataFrame(checks.band_findings(tables.read_table(spark, path), meta), checks.FINDINGS)


@query(f"WITH {GRID} SELECT (SELECT count(DISTINCT (x >> 2, y >> 2)) + count(DISTINCT (x >> 1, y >> 1)) + count(DISTINCT (x, y)) FROM gt)::bigint AS tiles, 3 AS zooms, 1 AS bands")
def inspect_summary(spark, d):
    i = checks.inspect(spark, _written(spark, d))
    return spark.createDataFrame([(i["tiles"], len(i["zooms"]), len(i["bands"]))], "tiles long, zooms int, bands int")


@query("SELECT * FROM (VALUES ('minresolution', 5), ('maxresolution', 12), ('block_width', 256), ('num_blocks', 77)) v(field, value)")
def old_metadata(spark, d):
    t = meta_.parse(json.dumps({"version": "0.2.0", "minresolution": 5, "maxresolution": 12, "block_width": 256, "block_height": 256, "num_blocks": 77, "nodata": 0, "bands": [{"name": "band_1", "type": "uint8"}]}))["tiling"]
    return spark.createDataFrame([("minresolution", t["min_zoom"]), ("maxresolution", t["max_zoom"]), ("block_width", t["block_width"]), ("num_blocks", t["num_blocks"])], "field string, value int")


# Pictures.


@query(f"WITH {GRID}, o AS (SELECT min(x) AS x0, min(y) AS y0 FROM gt) SELECT ((x - x0) * 16 + pc)::bigint AS \"column\", ((y - y0) * 16 + pr)::bigint AS \"row\", v::double AS value FROM gp JOIN gt USING (t), o")
def mosaic_pixels(spark, d):
    return export.mosaic(fx.grid_tiles(spark, d), "band_1", "int32", SIZE, GZ, -32768)


@query(f"WITH {FULL}, m AS (SELECT t, min(v) AS a, max(v) AS b FROM px GROUP BY t) SELECT block, sum(floor((v - a) / (b - a) * 255))::bigint AS total, 256::bigint AS n FROM px JOIN m USING (t) JOIN tl USING (t) GROUP BY block")
def render_uint8(spark, d):
    s = fx.float_tiles(spark, d).select("block", st.summary_udf("uint8")(px.display_udf("float32")("band_1")).alias("s"))
    return s.select("block", F.col("s.sum").cast("long").alias("total"), F.col("s.count").alias("n"))


@query("SELECT count(*) FILTER (c = 4) AS pictures, '89504E470D0A1A0A0000000D494844520000001000000010080200000090916836' AS head, '0000000049454E44AE426082' AS tail FROM (SELECT vec_id // 4 AS t, count(*) AS c FROM embeddings GROUP BY 1)")
def render_png(spark, d):
    p = fx.float_tiles(spark, d).select(F.hex(export.render_udf("float32", SIZE)(F.array("band_1", "band_2"))).alias("p"))
    return p.agg(F.count("*").alias("pictures"), F.max(F.substring("p", 1, 66)).alias("head"), F.max(F.right("p", F.lit(24))).alias("tail"))


@query(f"WITH {GRID} SELECT 128 AS width, 128 AS height, 'EPSG:3857' AS crs, 'int32' AS type, '64x64,32x32' AS overviews, count(*) AS n, sum(v)::double AS total FROM gp")
def export_file(spark, d):
    path = f"{_folder(spark)}.tif"
    i = export.export_table(spark, _written(spark, d), path)
    back = ingest.raster_tiles(spark, path, zoom=GZ, block_size=SIZE).select(st.summary_udf("int32", -32768)("band_1").alias("s")).agg(*st.merged_of("s"))
    return back.select(F.lit(i["size"][0]).alias("width"), F.lit(i["size"][1]).alias("height"), F.lit(i["crs"]).alias("crs"), F.lit(i["bands"][0]["type"]).alias("type"), F.lit(",".join(f"{a}x{b}" for a, b in i["overviews"])).alias("overviews"), F.col("count").alias("n"), F.col("sum").alias("total"))


# Choosing rows.


@query("""WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, o_totalprice::double AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
    g AS (SELECT o_custkey, o_orderkey, i, p <= 300000 AS taken, CASE WHEN p <= 300000 THEN 300000 - p ELSE 300000::double END AS rest FROM o WHERE i = 1
        UNION ALL SELECT o.o_custkey, o.o_orderkey, o.i, p <= rest, CASE WHEN p <= rest THEN rest - p ELSE rest END FROM g JOIN o ON o.o_custkey = g.o_custkey AND o.i = g.i + 1)
    SELECT o_custkey, o_orderkey FROM g WHERE taken""")
def size_budget_greedy(spark, d):
    o = fx.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.col("o_totalprice").cast("double").alias("p"))
    return layout.greedy_rows(o, ["o_orderdate", "o_orderkey"], "p", 300_000.0, "o_custkey").select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_totalprice)) AS o_orderkey FROM orders GROUP BY o_custkey")
def dedup_newest(spark, d):
    return layout.newest(fx.table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_totalprice").select("o_custkey", "o_orderkey")


@query(f"SELECT o_custkey, count(*) AS n, {q('max(running)', 2)} AS used FROM (SELECT o_custkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS running FROM orders) WHERE running <= 500000 GROUP BY o_custkey")
def size_budget_prefix(spark, d):
    kept = layout.within_budget(fx.table(spark, d, "orders"), [F.col("o_orderdate"), F.col("o_orderkey")], "o_totalprice", 500_000.0, "o_custkey")
    return kept.groupBy("o_custkey").agg(F.count("*").alias("n"), r(F.max("running"), 2).alias("used"))


# Terrain, ingest and services.


@query(f"""WITH {GRID}, e AS (SELECT c, r FROM (SELECT unnest(range(0, 128)) AS c), (SELECT unnest(range(0, 128)) AS r)), f AS (SELECT c, r, coalesce(v, -32768)::double AS v FROM e LEFT JOIN (SELECT x * 16 + pc AS c, y * 16 + pr AS r, v FROM gp JOIN gt USING (t)) USING (c, r)),
    n AS (SELECT o.c, o.r, o.dx, o.dy, g.v FROM (SELECT * FROM f, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)) o JOIN f g ON g.c = greatest(0, least(127, o.c + dx)) AND g.r = greatest(0, least(127, o.r + dy))),
    s AS (SELECT c, r, sum(v * dx * (CASE WHEN dy = 0 THEN 2 ELSE 1 END)) / 800 AS gx, sum(v * dy * (CASE WHEN dx = 0 THEN 2 ELSE 1 END)) / 800 AS gy FROM n GROUP BY c, r)
    SELECT {cell_sql("c // 16", "r // 16", GZ)} AS block, count(*) AS n, {q("sum(degrees(atan(sqrt(gx * gx + gy * gy)))::float::double)", 2)} AS total, {q("max(degrees(atan(sqrt(gx * gx + gy * gy)))::float::double)", 3)} AS steepest FROM s WHERE (c // 16, r // 16) IN (SELECT (x, y) FROM gt) GROUP BY c // 16, r // 16""")
def terrain_slope(spark, d):
    as_float = px.combine_udf(lambda a, b: a, "int32", "float32")("band_1", "band_1")
    t = fx.grid_tiles(spark, d).select("block", as_float.alias("band_1"))
    s = pyramid.hillslope(t, "band_1", "float32", SIZE, 100.0).select("block", st.summary_udf("float32")("slope").alias("s"))
    return s.select("block", F.col("s.count").alias("n"), r("s.sum", 2).alias("total"), r("s.max", 3).alias("steepest"))


#: A grid of a degree a value, from the line items, and its pixels on a zoom by SQL.
GRID_FILE = "gf AS (SELECT l_suppkey % 16 AS row, l_partkey % 16 AS col, sum(l_quantity)::bigint AS v FROM lineitem GROUP BY ALL)"


def _grid_file(spark, d) -> str:
    """The grid as an ASCII file; 256 rows at most come to the driver."""
    found = fx.table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 16).alias("row"), (F.col("l_partkey") % 16).alias("col")).agg(F.sum("l_quantity").cast("long").alias("v")).collect()
    values = {(x["row"], x["col"]): x["v"] for x in found}
    text = "ncols 16\nnrows 16\nxllcorner 10\nyllcorner 20\ncellsize 1\nNODATA_value -9999\n" + "\n".join(" ".join(str(values.get((i, j), -9999)) for j in range(16)) for i in range(16)) + "\n"
    path = f"{new_folder(spark)}/grid.asc"
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = jvm.getFileSystem(spark._jsc.hadoopConfiguration()).create(jvm)
    out.write(bytearray(text.encode()))
    out.close()
    return path


def _target_sql(z: int) -> str:
    """Pixels of a zoom under the grid file: gx, gy and the place (a, b) in source pixels."""
    n, k = (1 << z) * 16, z + 4
    return f"""tp AS (SELECT gx, gy, (gx + 0.5) / {n}.0 * 360 - 180 - 10 AS a, 36 - {lat_sql('gy + 0.5', k)} AS b FROM (SELECT unnest(range({int(190 / 360 * n) - 1}, {int(206 / 360 * n) + 2})) AS gx), (SELECT unnest(range({merc.tile_at(0, 36, k)[1] - 1}, {merc.tile_at(0, 20, k)[1] + 2})) AS gy))"""


@query(f"WITH {GRID_FILE}, {_target_sql(7)} SELECT {cell_sql('gx // 16', 'gy // 16', 7)} AS block, count(*) AS n, sum(v)::double AS total FROM tp JOIN gf ON floor(a) = col AND floor(b) = row WHERE a >= 0 AND a < 16 AND b >= 0 AND b < 16 GROUP BY gx // 16, gy // 16")
def ingest_finer_zoom(spark, d):
    t = ingest.raster_tiles(spark, _grid_file(spark, d), zoom=7, block_size=SIZE, resampling="near")
    return t.select("block", st.summary_udf("float32", -9999.0)("band_1").alias("s")).select("block", F.col("s.count").alias("n"), F.col("s.sum").alias("total"))


def _spans_sql(z: int, agg: str) -> str:
    """Source pixels by the target pixel that their centre falls in, where the target's own centre is in the grid."""
    n, k = (1 << z) * 16, z + 4
    return f"WITH {GRID_FILE}, {_target_sql(z)}, sp AS (SELECT floor((col + 10.5 + 180) / 360.0 * {n})::bigint AS gx, {y_sql('35.5 - row', k)} AS gy, v FROM gf), o AS (SELECT gx, gy, ({agg})::double AS v FROM sp JOIN tp USING (gx, gy) WHERE a >= 0 AND a < 16 AND b >= 0 AND b < 16 GROUP BY ALL) SELECT {cell_sql('gx // 16', 'gy // 16', z)} AS block, count(*) AS n, {q('sum(v::float::double)', 2)} AS total FROM o GROUP BY gx // 16, gy // 16"


def _ingest(how: str):
    def run(spark, d):
        t = ingest.raster_tiles(spark, _grid_file(spark, d), zoom=2, block_size=SIZE, resampling=how)
        return t.select("block", st.summary_udf("float32", -9999.0)("band_1").alias("s")).select("block", F.col("s.count").alias("n"), r("s.sum", 2).alias("total"))

    run.__name__ = f"ingest_{how}"
    return run


for _how, _agg in {"average": "avg(v)", "max": "max(v)", "min": "min(v)", "sum": "sum(v)", "med": "quantile_cont(v, 0.5)", "rms": "sqrt(avg(v::double * v))"}.items():
    query(_spans_sql(2, _agg))(_ingest(_how))


@query(f"WITH {GRID_FILE}, {_target_sql(5)}, p AS (SELECT v FROM tp JOIN gf ON floor(a) = col AND floor(b) = row WHERE a >= 0 AND a < 16 AND b >= 0 AND b < 16) SELECT 5 AS max_zoom, 'float32' AS type, 'gray' AS colorinterp, {q('min(v)')} AS low, {q('max(v)')} AS high, {q('avg(v)')} AS mean, {q('stddev_pop(v)')} AS sd, 0::bigint AS errors FROM p")
def raster_file_to_table(spark, d):
    path = _folder(spark)
    meta = ingest.convert_raster(spark, _grid_file(spark, d), path, block_size=SIZE, zoom=5, tile_statistics=True)
    b = meta["bands"][0]
    found = checks.validate(spark, path).agg(F.count_if(F.col("severity") == "error").alias("errors"))
    return found.select(F.lit(meta["tiling"]["max_zoom"]).alias("max_zoom"), F.lit(b["type"]).alias("type"), F.lit(b["colorinterp"]).alias("colorinterp"), *(r(F.lit(float(b[f"STATISTICS_{k}"]))).alias(n) for k, n in (("MINIMUM", "low"), ("MAXIMUM", "high"), ("MEAN", "mean"), ("STDDEV", "sd"))), "errors")


def _pretended(url: str, parameters: dict) -> tuple[int, dict, bytes]:
    """An image service whose pixels are column + 3 * row of their tile plus the tile's place; tile (1, 1) is empty."""
    import numpy as np

    if not url.endswith("/exportImage"):
        return 200, {}, json.dumps({"extent": {"xmin": 0.0, "ymin": 0.0, "xmax": merc.CIRCLE / 4, "ymax": merc.CIRCLE / 4, "spatialReference": {"wkid": 102100}}, "pixelType": "S32", "bandCount": 1, "noDataValue": -1, "columns": 64}).encode()
    w, _, _, n = (float(v) for v in parameters["bbox"].split(","))
    size = int(parameters["size"].split(",")[0])
    unit = merc.CIRCLE / 16
    x, y = round((w + merc.CIRCLE / 2) / unit), round((merc.CIRCLE / 2 - n) / unit)
    v = np.add.outer(3 * np.arange(size), np.arange(size)) + 100 * x + y
    return 200, {}, export.tiff((np.full_like(v, -1) if (x, y) == (9, 5) else v).astype("i4"), 0, 0, 1, size)


@query(f"SELECT {cell_sql('x', 'y', 4)} AS block, 256::bigint AS n, (sum(c + 3 * r + 100 * x + y))::double AS total FROM (SELECT unnest(range(8, 12)) AS x), (SELECT unnest(range(4, 8)) AS y), (SELECT unnest(range(0, 16)) AS c), (SELECT unnest(range(0, 16)) AS r) WHERE NOT (x = 9 AND y = 5) GROUP BY x, y")
def service_to_table(spark, d):
    path = _folder(spark)
    services.convert_service(spark, "http://example.org/service", path, size=SIZE, get=_pretended)
    return tables.read_table(spark, path).select("block", F.col("band_1_count").alias("n"), F.col("band_1_sum").alias("total"))


@query(f"WITH b AS (SELECT n_nationkey AS k, -170.0 + n_nationkey * 12.3 AS w, -60.0 + n_nationkey * 2.7 AS s, -150.5 + n_nationkey * 12.3 AS e, -42.0 + n_nationkey * 2.7 AS n FROM nation), p AS (SELECT *, {x_sql('w', 4)} AS x, {y_sql('n', 4)} AS y FROM b), c AS (SELECT k, 2 * x + i AS cx, 2 * y + j AS cy, w, s, e, n FROM p, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)) SELECT k, cx AS x, cy AS y FROM c WHERE cx BETWEEN {x_sql('w', 5)} AND {x_sql('e - 1e-11', 5)} AND cy BETWEEN {y_sql('n', 5)} AND {y_sql('s + 1e-11', 5)}")
def tile_children(spark, d):
    k = F.col("n_nationkey")
    w, s, e, n = -170.0 + k * 12.3, -60.0 + k * 2.7, -150.5 + k * 12.3, -42.0 + k * 2.7
    t = fx.table(spark, d, "nation").select(k.alias("k"), merc.children(merc.tile_x(w, 4), merc.tile_y(n, 4), 4, (w, s, e, n)).alias("t"))
    return t.select("k", F.explode("t").alias("t")).select("k", "t.x", "t.y")


@query(f"SELECT n_nationkey AS k, {q('least(n_nationkey, 3.0)')} AS \"left\", {q('n_nationkey + 5.0')} AS top, greatest(0, floor((-{merc.CIRCLE!r} / 2 + 21000000 + n_nationkey * 10000) / 1000))::bigint AS first FROM nation")
def outer_window(spark, d):
    k = F.col("n_nationkey").cast("double")
    box = merc.outer_bounds([(k, F.lit(1.0)), (F.lit(3.0), k + 5), (k + 1, F.lit(0.0)), (F.lit(40.0), F.lit(2.0))])
    win = merc.clipped_window(-21_000_000 - k * 10_000, F.lit(1000.0), F.lit(100_000))
    return fx.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), r(box["left"]).alias("left"), r(box["top"]).alias("top"), win["first"].alias("first"))


# SQL over written tables.


@query(f"WITH {FULL}, {CENTRE} SELECT {STATS_SQL} FROM ce WHERE {INSIDE}")
def sql_region_stats(spark, d):
    area = f"'{WKT}'"
    return names.query(spark, f"SELECT s.count AS n, round(s.sum, 4) + 0.0D AS total, round(s.mean, 4) + 0.0D AS mean, round(s.min, 4) + 0.0D AS low, round(s.max, 4) + 0.0D AS high, round(s.stddev, 4) + 0.0D AS sd FROM (SELECT st_regionstats(band_1, block, {area}, metadata) AS s FROM read_tiles('{_written_floats(spark, d)}', {area}))")


@query(f"WITH {FULL}, {TILE_BOX} SELECT block FROM bx WHERE e > -170.3 AND w < 150.7 AND n > -70.2 AND s < 65.1")
def sql_intersects(spark, d):
    return names.query(spark, f"SELECT block FROM read_tiles('{_written_floats(spark, d)}') WHERE ST_Intersects(block, ST_GeomFromText('{WKT}'))")


@query(f"WITH {FULL}, {ON_TILES} SELECT event_id, {q('v')} AS value FROM pt JOIN px USING (t, pc, pr)")
def sql_raster_value(spark, d):
    _on_tiles(spark, d).createOrReplaceTempView("_places")
    return names.query(spark, f"SELECT event_id, round(st_rastervalue(block, band_1, st_point(lon, lat), metadata), 4) + 0.0D AS value FROM _places JOIN read_tiles('{_written_floats(spark, d)}') ON block = cell_from_point(lon, lat, {Z})")


@query(f"WITH {FULL}, {CENTRE} SELECT block, count(*) AS n, {q('sum(v)')} AS total FROM ce WHERE lon > -20.4 AND lon < 41.3 AND lat > -31.7 AND lat < 52.9 GROUP BY block")
def sql_clip(spark, d):
    area = "'POLYGON((-20.4 -31.7, 41.3 -31.7, 41.3 52.9, -20.4 52.9, -20.4 -31.7))'"
    return names.query(spark, f"SELECT block, count(*) AS n, round(sum(p.value), 4) + 0.0D AS total FROM (SELECT block, explode(st_clip(band_1, block, {area}, metadata)) AS p FROM read_tiles('{_written_floats(spark, d)}', {area})) GROUP BY block")


@query(f"WITH {FULL} SELECT block, {q('avg(v)')} AS mean, count(*) FILTER (v + w <> 0) AS n, count(*) AS count FROM px JOIN tl USING (t) GROUP BY block")
def sql_summary(spark, d):
    return names.query(spark, f"SELECT block, round(st_rastersummarystat(block, band_1, 'mean', metadata), 4) + 0.0D AS mean, st_normalizeddifferencestats(band_1, band_2, metadata).count AS n, st_rastersummarystats(band_1, metadata).count AS count FROM read_tiles('{_written_floats(spark, d)}')")


@query(f"WITH {GRID} SELECT 1 AS min_zoom, 3 AS max_zoom, 16 AS block_width, count(*) AS num_blocks, 'EPSG:3857' AS crs FROM gt")
def sql_metadata(spark, d):
    return names.query(spark, f"SELECT min_zoom, max_zoom, block_width, num_blocks, crs FROM read_tiles_metadata('{_written(spark, d)}')")


@query(f"WITH {GRID} SELECT block, sum(v)::double AS total, 'int32' AS type FROM gp JOIN gt USING (t) WHERE x = {merc.tile_at(30.0, 20.0, GZ)[0]} AND y = {merc.tile_at(30.0, 20.0, GZ)[1]} GROUP BY block")
def sql_read_at(spark, d):
    return names.query(spark, f"SELECT block, band_1_sum AS total, get_json_object(metadata, '$.bands[0].type') AS type FROM read_tiles_at('{_written(spark, d)}', 30.0, 20.0)")


@query(f"WITH {POINTS}, p AS (SELECT {x_sql('lon', 4)} AS x, {y_sql('lat', 4)} AS y, greatest(0, least(15, floor((lon / 360.0 + 0.5) * 256) - 16 * {x_sql('lon', 4)}))::int AS pc, greatest(0, least(15, floor((0.5 - 0.25 * ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / pi()) * 256) - 16 * {y_sql('lat', 4)}))::int AS pr, value FROM points), g AS (SELECT x, y, pr, pc, sum(value) AS v FROM p GROUP BY ALL) SELECT {cell_sql('x', 'y', 4)} AS block, count(*) AS n, {q('sum(v)', 2)} AS total FROM g GROUP BY x, y")
def points_to_tiles(spark, d):
    t = convert.pixel_tiles(fx.points(spark, d), 4, SIZE, "float64", ["value"], how="sum")
    s = t.select("block", st.summary_udf("float64")("band_1").alias("s"))
    return s.select("block", F.col("s.count").alias("n"), r("s.sum", 2).alias("total"))


@query(f"WITH {POINTS} SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, {cell_sql(x_sql('lon', 4), y_sql('lat', 4), 4)} AS block, count(value) AS n, {q('sum(value)', 2)} AS total FROM points GROUP BY 1, 2")
def cell_windows(spark, d):
    from tilecairn.streaming.tiles import cell_windows as windows

    w = windows(fx.points(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), 4)
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "block", F.col("count").alias("n"), r("sum", 2).alias("total"))


@query(f"WITH {FULL}, {CENTRE} SELECT count(*) AS n, {q('sum(v)')} AS total, {q('stddev_pop(v)')} AS sd FROM ce WHERE {INSIDE}")
def sql_star_and_casts(spark, d):
    area = f"'{WKT}'::GEOMETRY"
    return names.query(spark, f"SELECT count AS n, round(sum, 4) + 0.0D AS total, round(stddev, 4) + 0.0D AS sd FROM (SELECT (ST_RegionStats(band_1, block, {area}, metadata)).* FROM read_tiles('{_written_floats(spark, d)}', {area}))")


@query(f"WITH {FULL}, {TILE_BOX}, i AS (SELECT t FROM bx WHERE e > -170.3 AND w < 150.7 AND n > -70.2 AND s < 65.1) SELECT {q('sum(v)')} AS total, {q('avg(v)')} AS mean FROM px JOIN i USING (t)")
def sql_other_dialect(spark, d):
    return names.query(spark, f"SELECT round(SUM(RASTER_ST_SUMMARYSTATS(block, band_1).sum), 4) + 0.0D AS total, round(AVG((RASTER_ST_SUMMARYSTATS(block, band_1)).mean), 4) + 0.0D AS mean FROM read_tiles('{_written_floats(spark, d)}') WHERE RASTER_ST_INTERSECTS(block, ST_GEOGFROMTEXT('{WKT}'))")


# Ways to read, and joins of unequal zooms.


@query(f"WITH {FULL} SELECT block, {q('sum(w)')} AS total FROM px JOIN tl USING (t) GROUP BY block")
def band_projection(spark, d):
    t = tables.read_table(spark, _written_floats(spark, d), ["band_2"], Z)
    assert not any(c.startswith("band_1") for c in t.columns)
    return t.select("block", r(st.summary_udf("float32")("band_2")["sum"]).alias("total"))


def _at_zoom_sql(zoom: int) -> str:
    k = GZ - zoom
    a, b = merc.tile_at(-100, 50, zoom), merc.tile_at(100, -50, zoom)
    return f"WITH {GRID} SELECT {cell_sql(f'x >> {k}', f'y >> {k}', zoom)} AS block, sum(v)::double AS total FROM gp JOIN gt USING (t) WHERE x >> {k} BETWEEN {a[0]} AND {b[0]} AND y >> {k} BETWEEN {a[1]} AND {b[1]} GROUP BY x >> {k}, y >> {k}"


@query(_at_zoom_sql(1))
def read_region_coarsest(spark, d):
    return tables.read_region(spark, _written(spark, d), box_area(-100, -50, 100, 50), "min").select("block", F.col("band_1_sum").alias("total"))


@query(_at_zoom_sql(3))
def read_region_auto(spark, d):
    return tables.read_region(spark, _written(spark, d), box_area(-100, -50, 100, 50), "auto").select("block", F.col("band_1_sum").alias("total"))


@query(f"WITH {GRID} SELECT {cell_sql('x >> 1', 'y >> 1', 2)} AS block, sum(v)::double AS total FROM gp JOIN gt USING (t) WHERE x >> 1 = 2 AND y >> 1 = 1 GROUP BY x >> 1, y >> 1")
def read_tile(spark, d):
    return tables.read_tile(spark, _written(spark, d), 2, 1, 2).select("block", F.col("band_1_sum").alias("total"))


@query(f"WITH {FULL}, o AS (SELECT block, row_number() OVER (ORDER BY block) AS i, count(*) OVER () AS n FROM tl) SELECT block FROM o WHERE i IN (1, (n + 1) // 2, n)")
def sampled_tiles(spark, d):
    return checks.sampled(tables.read_table(spark, _written_floats(spark, d)).select("block"))


@query(f"WITH {GRID}, f AS (SELECT t, x, y, block, sum(v)::double AS fine FROM gp JOIN gt USING (t) GROUP BY ALL), c AS (SELECT x >> 1 AS x, y >> 1 AS y, sum(fine) AS coarse FROM f GROUP BY ALL) SELECT f.block, fine, coarse FROM f JOIN c ON f.x >> 1 = c.x AND f.y >> 1 = c.y")
def raster_join_of_two_zooms(spark, d):
    t = tables.read_table(spark, _written(spark, d))
    fine, coarse = (t.where(in_zoom(F.col("block"), z)).select("block", F.col("band_1_sum").alias(n)) for z, n in ((3, "fine"), (2, "coarse")))
    return zonal.raster_join(fine, coarse, 3, 2).select("block", "fine", "coarse")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN strftime(TIMESTAMP '2000-01-01' + to_days((event_id % 100)::int), '%Y-%m-%d') END AS stamp FROM events")
def cf_calendars(spark, d):
    e = F.col("event_id")
    calendar = F.element_at(F.array(*map(F.lit, ("Gregorian", "360_day", "noleap", "julian"))), (e % 4 + 1).cast("int"))
    t = cftime.to_timestamp((e % 100).cast("double"), F.lit("days"), F.lit("2000-01-01").cast("timestamp_ntz"), calendar)
    return fx.table(spark, d, "events").select("event_id", F.date_format(t, "yyyy-MM-dd").alias("stamp"))


@query(f"WITH {POINTS} SELECT event_id, {q(f'lon * {merc.CIRCLE!r} / 360', 3)} AS x, {q(f'ln(tan(radians(lat) / 2 + pi() / 4)) * {merc.RADIUS!r}', 3)} AS y, {q('lon', 6)} AS lon, {q('lat', 6)} AS lat FROM points")
def mercator_metres(spark, d):
    p = fx.points(spark, d)
    x, y = merc.metres(F.col("lon"), F.col("lat"))
    p = p.select("event_id", x.alias("x"), y.alias("y"))
    lon, lat = merc.degrees(F.col("x"), F.col("y"))
    return p.select("event_id", r("x", 3).alias("x"), r("y", 3).alias("y"), r(lon, 6).alias("lon"), r(lat, 6).alias("lat"))


@query(f"WITH {FULL}, {CENTRE} SELECT {STATS_SQL} FROM ce WHERE {INSIDE}")
def zonal_stats_stored(spark, d):
    zone = spark.createDataFrame([("a", WKT)], "zone string, wkt string")
    return rounded_stats(zonal.zonal_stats(_stored(spark, d), zone, "band_1", "float32", Z, SIZE, stored=True))
