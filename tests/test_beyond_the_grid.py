"""Tables whose keys run past the grid's edges, as larger copies of the supplied ones do, against the SQL, and rasters of large empty areas."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark import queries
from tidemark.operators import shapes
from tidemark.sources import rasters

from .test_queries import DATA, TABLES, rows

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
ROUND = 360 * 1200  # columns once around


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """The smallest tables with three copies of lineitem: as it is, once around the globe, and beyond the last row and column."""
    out = tmp_path_factory.mktemp("far")
    for t in TABLES:
        if t != "lineitem":
            (out / f"{t}.parquet").symlink_to(f"{DATA}/{t}.parquet")
    one = spark.read.parquet(f"{DATA}/lineitem.parquet")
    moved = lambda c, r: one.withColumns({"l_partkey": F.col("l_partkey") + c, "l_suppkey": F.col("l_suppkey") + r})
    one.union(moved(ROUND, 0)).union(moved(100_000, 50_000)).write.parquet(f"{out}/lineitem.parquet")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{out}/{t}.parquet{'/*.parquet' if t == 'lineitem' else ''}'")
    return str(out), con


def same(spark, far, name):
    df, cursor = queries.QUERIES[name](spark, far[0]), far[1].execute(queries.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert rows(df.columns, df.collect()) == rows(names, cursor.fetchall())


@pytest.mark.parametrize("name", ["raster_headers", "raster_scan"])
def test_rasters_with_far_pixels(spark, far, name):
    same(spark, far, name)


def test_empty_areas_of_a_raster_are_not_stored(spark):
    at = [(0, 0, 3.0), (1_200_000, 0, 4.0), (1_200_000, 60_000, 5.0), (1_200_000, 60_000, 2.0)]
    made = rasters.encode(spark.createDataFrame([("a", *p) for p in at], "raster string, col int, row int, value double"), -46.8, 85.1, 1 / 1200)
    data = made.first().content
    told, blocks = rasters.header(bytes(data))
    assert (told["width"], told["height"], len(blocks)) == (1_200_001, 60_001, 3) and len(data) < 20_000_000
    found = spark.createDataFrame([("a", data)], "raster string, content binary")
    assert sorted((r.col, r.row, r.value) for r in rasters.pixels(found).collect()) == [(0, 0, 3.0), (1_200_000, 0, 4.0), (1_200_000, 60_000, 5.0)]


def test_blocks_left_out_are_zeros_where_no_data_are_declared(spark):
    import numpy as np

    row = np.ones((2, 3), dtype="<f4").tobytes()
    found = {"told": rasters.assemble([row, b""], 3, 4, 2, 0.0, 9.0, 1.0, 1.0, 4326, -1.0, compression=1), "none": rasters.assemble([row, b""], 3, 4, 2, 0.0, 9.0, 1.0, 1.0, 4326, None, compression=1)}
    table = spark.createDataFrame([(k, bytearray(v)) for k, v in found.items()], "raster string, content binary")
    count = lambda dry: {(r.raster, r.value): r["count"] for r in rasters.pixels(table, dry=dry).groupBy("raster", "value").count().collect()}
    assert count(True) == {("told", 1.0): 6, ("none", 1.0): 6, ("none", 0.0): 6}
    assert count(False) == {("told", 1.0): 6, ("none", 1.0): 6}


def test_lines_are_met_without_a_broadcast_of_their_strips(spark):
    lines = spark.createDataFrame([(1, 6.1, 52.18, 6.2, 52.1)], "shape long, x0 double, y0 double, x1 double, y1 double")
    cells = spark.createDataFrame([(63500, 39500, 7)], "col int, row int, flood_id long")
    plan = shapes.line_counts(lines, cells)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [row" in plan


@pytest.mark.parametrize("name", ["floods_radius"])
def test_a_circle_meets_longitudes_that_come_round(spark, far, name):
    same(spark, far, name)


def test_process_status_beyond_the_grid(spark, far):
    same(spark, far, "process_status")


def test_raster_lake_beyond_the_grid(spark, far):
    same(spark, far, "raster_lake")


def test_raster_outcomes_beyond_the_grid(spark, far):
    same(spark, far, "raster_outcomes")


def test_raster_resume_beyond_the_grid(spark, far):
    same(spark, far, "raster_resume")
