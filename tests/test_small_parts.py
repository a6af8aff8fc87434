"""Parts of the engine that no query calls."""

from pyspark.sql import functions as F

from tidemark.operators import catalog, depth, inventory
from tidemark.plans import bundle, ingest
from tidemark.sources import tables


def test_first_seen_and_scales(spark):
    rows = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z")], "k string, o int, v string")
    assert sorted((r.k, r.v) for r in catalog.first_seen(rows, "k", "o").collect()) == [("a", "y"), ("b", "z")]
    found = spark.createDataFrame([("hazard",), ("historic",)], "c string").select(depth.depth_scale(F.col("c")).alias("s"))
    assert [r.s for r in found.collect()] == [1.0, 0.01]


def test_inventory_pages_and_files(spark, tmp_path):
    page = spark.createDataFrame([('<a href="../">up</a><a href="2019/">x</a> <a href="2020/">y</a> <a href="2020/">y</a><a href="notes/">n</a>',)], "html string")
    assert sorted(r.year for r in inventory.year_folders(page).collect()) == ["2019", "2020"]
    good = (1, "2020-01-01", "2020-01-02", "2020", "1", "f", "u", 5)
    records = spark.createDataFrame([good, (2, "2020-13-01", None, "2020", "1", "g", "u", 5), (3, "2020-01-01", "never", "2020", "1", "h", "u", 5)], tables.INVENTORY)
    assert tables.write_inventory(records, str(tmp_path / "inv")) and [r.global_id for r in tables.read_inventory(spark, str(tmp_path / "inv")).collect()] == [1]
    assert not tables.write_inventory(records.where("global_id > 1"), str(tmp_path / "none")) and not (tmp_path / "none").exists()


def test_dead_letters_and_plans(spark, tmp_path):
    lines = spark.createDataFrame([(1, "ok", "failed", 1), (1, "ok", "complete", 2), (2, "failed", None, 1), (3, "ok", "missing_crs", 1), (4, "ok", "empty", 1)], "global_id long, download_status string, process_status string, line long")
    assert sorted(r.global_id for r in ingest.dead_letters(lines).collect()) == [2, 3]
    lake = spark.createDataFrame([(1, 1, 5), (1, 1, 6), (2, 1, 5)], tables.LAKE)
    assert tuple(bundle.export_plan(lake).first()) == (2, 2 * bundle.BYTES_PER_CELL)
    bundle.build(lake, str(tmp_path / "i"))
    listed = bundle.file_manifest(spark, str(tmp_path / "i")).collect()
    assert listed and all(r.size_bytes > 0 and len(r.sha256) == 64 for r in listed)


def test_statistics_in_the_unit_of_a_collection(spark):
    pixels = spark.createDataFrame([(7, 0, 0, 250.0), (100, 0, 0, 2.5), (9, 0, 0, 1.0)], "raster_id long, col int, row int, value double")
    events = spark.createDataFrame([(7,)], "event_id long")
    modelled = spark.createDataFrame([(100,)], "return_period int")
    assert [(r.raster_id, r.max_depth_m) for r in depth.catalogue_stats(events, pixels, 400.0).collect()] == [(7, 2.5)]
    assert [(r.raster_id, r.max_depth_m) for r in depth.catalogue_stats(modelled, pixels, 400.0).collect()] == [(100, 2.5)]
    assert depth.catalogue_stats(events, pixels, 400.0, scale=1.0).first().max_depth_m == 250.0
