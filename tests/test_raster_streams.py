"""Rasters written and read as streams of blocks: what a task holds does not grow with the area, and batches may end anywhere."""

import math
import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark import queries
from tidemark.sources import rasters

from .test_queries import DATA
from .test_rasters import files, plain

PIXEL = "raster string, col int, row int, value double"


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_directory_of_a_million_blocks_is_read_in_place(spark):
    made = rasters.encode(spark.createDataFrame([("a", 0, 0, 3.0), ("a", 1_200_000, 60_000, 5.0)], PIXEL), -46.8, 85.1, 1 / 1200)
    data = bytes(made.first().content)
    tracemalloc.start()
    told, blocks = rasters.header(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert -(-told["width"] // told["block_width"]) * -(-told["height"] // told["block_height"]) > 1_000_000 and len(blocks) == 2
    assert peak < 4_000_000


def test_blocks_and_files_are_not_gathered_in_aggregates(spark, monkeypatch):
    from tidemark.plans import scratch

    monkeypatch.setattr(scratch, "TASK_ROWS", 10)
    rows = spark.range(200).select(F.lit("a").alias("raster"), (F.col("id") * 7).cast("int").alias("col"), F.col("id").cast("int").alias("row"), F.lit(2.0).alias("value"))
    made = plan(rasters.encode(rows, 0.0, 80.0, 0.01))
    assert "collect_list" not in made
    assert "hashpartitioning(raster#" in made and ", 20)" in made  # 200 pixels in tasks of 10


def test_the_largest_value_wins_across_batches(spark, small_batches):
    rows = [("a", c, r, float(v)) for c in range(0, 3000, 600) for r in (0, 70) for v in (5, 9, 1, 7, 2)] + [("b", 0, 0, None), ("b", 0, 0, 4.0), ("b", 1, 0, None), ("b", 2, 0, math.nan), ("b", 2, 0, 6.0), ("b", 3, 0, -1.0), ("b", 3, 0, -2.0)]
    made = rasters.encode(spark.createDataFrame(rows, PIXEL).repartition(3), 0.0, 80.0, 0.01)
    assert {(r.raster, r.width, r.height, r.compression) for r in rasters.headers(made).collect()} == {("a", 2401, 71, 50000), ("b", 4, 1, 50000)}
    found = sorted((r.raster, r.col, r.row, r.value) for r in rasters.pixels(made).collect())
    assert found == sorted([("a", c, r, 9.0) for c in range(0, 3000, 600) for r in (0, 70)] + [("b", 0, 0, 4.0), ("b", 3, 0, -1.0)])
    assert rasters.encode(spark.createDataFrame([], PIXEL), 0.0, 80.0, 0.01).count() == 0


def test_zstandard_blocks_of_another_size(spark):
    """A writer may leave the rows behind the raster's end out of the last tile."""
    values = np.ones((5, 4), dtype="<f4")
    pack = lambda v: pa.Codec("zstd").compress(v.tobytes(), asbytes=True)
    data = rasters.assemble([pack(values[:4]), pack(values[4:])], 4, 5, 4, 0.0, 9.0, 1.0, 1.0, 4326, 0.0, compression=50000, tile=4)
    assert rasters.pixels(files(spark, {"a.tif": data})).count() == 20


def test_pixels_of_many_rasters_keep_their_names_and_places(spark, small_batches):
    r = np.random.default_rng(4)
    made = {f"{k}.tif": (r.random((9, 8 + k % 3)) < 0.2) * np.float32(k + 1) for k in range(12)}  # some share a header
    found = rasters.pixels(files(spark, {k: plain(v, 10.0, 50.0, 0.5, 0.25, 4326, rows=2) for k, v in made.items()})).collect()
    assert sorted((p.raster, p.col, p.row, p.value) for p in found) == sorted((k, int(c), int(w), float(v[w, c])) for k, v in made.items() for w, c in np.argwhere(v))
    assert all((p.lon, p.lat) == pytest.approx((10 + (p.col + 0.5) * 0.5, 50 - (p.row + 0.5) * 0.25)) for p in found)


def test_values_of_nearly_empty_blocks():
    for shape in ((16, 16), (5, 7), (1, 8)):
        v = np.zeros(shape, dtype="<f4")
        v.reshape(-1)[[0, 3, v.size - 1]] = (np.nan, -0.0, 2.0)
        assert rasters._nonzero(v).tolist() == np.flatnonzero(v).tolist()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_events_of_a_lake_are_looked_up_without_a_shuffle_of_the_pixels(spark):
    """However large the table that they come from is."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        made = plan(queries.QUERIES["raster_lake"](spark, DATA))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in made and "BroadcastHashJoin [raster#" in made
