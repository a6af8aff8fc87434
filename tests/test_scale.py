"""Layouts and figures that hold at any size: pruned folders, footers, overview levels and quantiles."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import depth, recurrence, roi
from tidemark.plans import bundle
from tidemark.sources import tables


def plan(df):
    return df._jdf.queryExecution().toString()


def test_a_region_reads_its_folders_only(spark, tmp_path):
    lake = spark.range(4000).select((F.col("id") * 7 % 3000 + 60_000).cast("int").alias("col"), (F.col("id") * 13 % 5000 + 38_000).cast("int").alias("row"), (F.col("id") % 3).alias("flood_id"))
    bundle.build(lake, str(tmp_path / "index"))
    index, _, _ = bundle.open_index(spark, str(tmp_path / "index"))
    box = roi.from_bbox((4.0, 51.0, 5.0, 51.3))
    found = box.mask(index)
    assert "PartitionFilters: [isnotnull(tile_row" in plan(found).replace("#", "").replace("\n", "") or "tile_row" in plan(found).split("PartitionFilters: [")[1].split("]")[0]
    assert sorted(map(tuple, found.select("col", "row").collect())) == sorted(map(tuple, box.mask(index.drop("tile_row")).select("col", "row").collect()))


def test_torn_files_are_named_and_not_fatal(spark, tmp_path):
    cells = spark.range(900).select((F.col("id") % 100).cast("int").alias("col"), F.lit(5).cast("int").alias("row"), (F.col("id") % 3 + 1).alias("flood_id"), F.lit(2020).alias("year"))
    path = tmp_path / "lake"
    tables.write_lake(cells, str(path))
    torn = next(path.rglob("event=2/*.parquet"))
    torn.write_bytes(torn.read_bytes()[:-20])
    (torn.parent / f".{torn.name}.crc").unlink(missing_ok=True)
    empty = tmp_path / "empty"
    cells.where("false").drop("year").coalesce(1).write.parquet(str(empty))
    next(empty.glob("*.parquet")).rename(path / "year=2020" / "event=3" / "nothing.parquet")
    found = {r.path.split("event=")[1].split("/")[0]: r.rows for r in tables.file_rows(spark, str(path)).where("NOT path LIKE '%nothing%'").collect()}
    assert found == {"1": 300, "2": None, "3": 300}
    assert tables.file_rows(spark, str(path)).where("path LIKE '%nothing%'").first().rows == 0
    assert {(r.flood_id, r.points) for r in tables.cached_points(spark, str(path)).collect()} == {(1, 300), (3, 300)}


def test_overviews_equal_single_levels_and_share_a_shuffle(spark):
    r = random.Random(4)
    cells = spark.createDataFrame(list({(r.randrange(500), r.randrange(300)): r.randrange(1, 9) for _ in range(3000)}.items()), "at struct<col:int,row:int>, n_events int").select("at.col", "at.row", "n_events")
    levels = recurrence.overviews(cells, 4)
    for k in (2, 4, 8, 16):
        want = sorted(map(tuple, recurrence.coarser(cells, k).collect()))
        assert sorted(map(tuple, levels.where(F.col("factor") == k).drop("factor").collect())) == want
    assert plan(levels).split("== Physical Plan ==")[1].count("hashpartitioning(block") + plan(levels).count("ReusedExchange") <= 9
    z = spark.createDataFrame([(5, 3)], "a int, b int").select(recurrence.zorder(F.col("a"), F.col("b"))).first()[0]
    assert z == int("".join(f"{b}{a}" for a, b in zip(f"{5:03b}", f"{3:03b}", strict=True)), 2)


@pytest.mark.parametrize("share", [0.0, 0.95])
def test_quantiles_by_ranges_equal_sorted_ones(spark, share):
    r = random.Random(6)
    rows = [("a", r.gauss(0, 1)) for _ in range(2000)] + [("b", float(r.randrange(3))) for _ in range(1500)] + [("c", 7.5)] * 900 + [("d", 1.0)] + [("e", 10.0**k) for k in range(-300, 300)] + [("a", None), ("a", float("nan")), (None, 3.0)]
    table = spark.createDataFrame(rows, "g string, x double").repartition(4)
    want = {x.g: x.p for x in table.where("x IS NOT NULL AND NOT isnan(x)").groupBy("g").agg(F.percentile("x", F.lit(share)).alias("p")).collect()}
    found = {x.g: x.quantile for x in depth.exact_quantiles(table, ["g"], "x", share, bins=8, gathered=5).collect()}
    want.pop(None)
    assert found == pytest.approx(want, rel=1e-12)
    assert depth.exact_quantiles(table.where("g = 'a'"), [], "x", share, bins=8, gathered=50).first().quantile == pytest.approx(want["a"], rel=1e-12)
