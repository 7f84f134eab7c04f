"""The driver's contract."""

import duckdb
import pytest

D = "/root/testdata/sf0.001"


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["cell_parent", "tile_summary_stats", "region_stats_stored", "zonal_stats_by_region", "raster_value_at_points", "overview_average", "timeseries_by_year", "bbox_tiles"])
def test_queries_match_their_sql(spark, name):
    import __spark_entry__ as e

    c = duckdb.connect()
    for t in ("nation", "region", "events", "embeddings", "lineitem", "part", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    a = e.queries()[name](spark, D).toPandas()
    b = c.execute(e.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    key = lambda df: sorted(df[sorted(df.columns)].astype(str).replace({"nan": "None", "<NA>": "None"}).itertuples(index=False, name=None))
    for x, y in zip(key(a), key(b), strict=True):
        for p, q in zip(x, y, strict=True):
            assert p == q or float(p) == pytest.approx(float(q), abs=1e-4)
