"""Small worked examples of the engine's rules."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import grid
from tidemark.functions import text as T
from tidemark.operators import catalog, depth, exposure, hazard, inventory, lake, recurrence, regions, roi
from tidemark.plans import bundle, ingest
from tidemark.sources import tables
from tidemark.streaming import cells as stream

COL, ROW = 68_160, 42_120  # at 10 E, 50 N


@pytest.fixture
def small(spark):
    """Ten rows of cells; the upper five of events 10, 11 and 12, the lower five of event 10."""
    upper = [(COL + c, ROW + r, e) for c in range(10) for r in range(5) for e in (10, 11, 12)]
    lower = [(COL + c, ROW + r, 10) for c in range(10) for r in range(5, 10)]
    return spark.createDataFrame(upper + lower, tables.LAKE)


def events(spark):
    rows = [(i, f"20{i}-05-01", f"20{i}-05-09", f"20{i}", "1", f"f{i}.tif", f"u/f{i}.tif") for i in (10, 11, 12)]
    return spark.createDataFrame(rows, tables.EVENTS)


def index(small):
    cells = lake.build_cells(small)
    combos = lake.number_combos(cells)
    return lake.build_pixel_combo(cells, combos), combos


def test_three_wet_pixels_make_one_event(spark):
    pixels = spark.createDataFrame([(10.0 + i / 1000, 49.99, 2.0, 20) for i in range(3)] + [(10.0, 49.99, 0.0, 21)], "lon double, lat double, value double, flood_id long")
    found = lake.pixels_to_lake(pixels)
    assert found.count() == 3 or found.count() == 2
    assert {r.flood_id for r in found.collect()} == {20}


def test_duplicate_pixels_are_one_cell(spark):
    pixels = spark.createDataFrame([(10.0001, 49.9999, 1.0, 1)] * 10, "lon double, lat double, value double, flood_id long")
    assert lake.pixels_to_lake(pixels).count() == 1


def test_id_range(spark):
    make = lambda i: lake.pixels_to_lake(spark.createDataFrame([(10.0, 50.0 - 1e-4, 1.0, i)], "lon double, lat double, value double, flood_id long"))
    assert make(2**32 - 1).count() == 1
    with pytest.raises(Exception, match="32 bits"):
        make(2**32).collect()


def test_recurrence_and_areas(spark, small):
    cells, combos = index(small)
    assert {tuple(r.flood_ids): r.combo_id for r in combos.collect()} == {(10,): 1, (10, 11, 12): 2}
    assert recurrence.recurrence_grid(cells, combos).agg(F.max("n_events")).first()[0] == 3
    region = roi.from_bbox((9.9, 49.9, 10.1, 50.1))
    found = {r.event_id: r for r in catalog.floods(cells, combos, events(spark), region).collect()}
    side = grid.RESOLUTION * grid.METRES_PER_DEGREE
    import math

    assert found[10].area_km2 == round(100 * side * side * math.cos(math.radians(region.centroid_lat)) / 1e6, 3)
    assert found[11].date == "2011-05-01" and set(found) == {10, 11, 12}
    only = catalog.floods(cells, combos, events(spark), region, start="2011", end="2011")
    assert [r.event_id for r in only.collect()] == [11]
    away = catalog.floods(cells, combos, events(spark), roi.from_bbox((0, 40, 1, 41)))
    assert away.columns == catalog.COLUMNS and away.count() == 0
    prints = {r.event_id: (r.cells, r.duration_days) for r in recurrence.footprints(cells, combos, events(spark)).collect()}
    assert prints == {10: (100, 8), 11: (50, 8), 12: (50, 8)}
    assert sorted(r.cells for r in recurrence.regions(cells).collect()) == [50, 50]


def test_regions_touch_by_sides(spark):
    ring = [(c, r) for c in range(5) for r in range(5) if c in (0, 4) or r in (0, 4)]
    snake = [(10 + i, 0) for i in range(5)] + [(14, 1), (14, 2)] + [(10 + i, 2) for i in range(5)] + [(10, 3), (10, 4)]
    corner = [(20, 0), (21, 1)]
    cells = spark.createDataFrame([(COL + c, ROW + r, 1) for c, r in ring + snake + corner], "col int, row int, combo_id long")
    assert sorted(r.cells for r in recurrence.regions(cells).collect()) == [1, 1, len(snake), len(ring)]


def test_unknown_combo_has_no_recurrence(spark, small):
    cells, combos = index(small)
    found = recurrence.recurrence_grid(cells.withColumn("combo_id", F.lit(99)), combos)
    assert {r.n_events for r in found.collect()} == {0}


def test_bundle_round_trip(spark, small, tmp_path):
    path = str(tmp_path / "index")
    made = bundle.build(small, path, events(spark))
    assert made["n_combos"] == 2 and made["n_cells"] == 100
    cells, combos, known = bundle.open_index(spark, path)
    assert all(r.ok for r in bundle.doctor(cells, combos, known).collect())
    assert combos.count() == 2 and known.count() == 3
    assert bundle.restamp(spark, path, {"a": "b"})["source_urls"] == {"a": "b"}
    with pytest.raises(bundle.ManifestError):
        bundle.open_index(spark, str(tmp_path / "none"))
    with pytest.raises(bundle.ManifestError):
        bundle.validate_manifest(made | {"grid": made["grid"] | {"width_px": 1}})
    with pytest.raises(bundle.IndexMissingError):
        bundle.locate(None, "store://x", offline=True)
    assert tables.read_events(spark, str(tmp_path / "none")).count() == 0


def test_depth_statistics(spark):
    wet = [(1, 100 + c, 100 + r, 2.5) for c in range(4) for r in range(4)]
    rows = spark.createDataFrame(wet + [(1, 0, 0, 0.0), (2, 0, 0, 0.0)], "raster_id long, col int, row int, value double")
    found = {r.raster_id: r for r in depth.stats(rows, 10_000.0, scale=1.0).collect()}
    assert (found[1].max_depth_m, found[1].mean_depth_m, found[1].p95_depth_m) == (2.5, 2.5, 2.5)
    assert (found[1].area_km2, found[1].volume_m3, found[1].volume_mm3) == (0.16, 400_000.0, 0.4)
    assert (found[2].n_pixels, found[2].max_depth_m, found[2].volume_m3) == (0, 0.0, 0.0)
    assert depth.stats(rows, 1.0, max_depth=2.0).agg(F.max("n_pixels")).first()[0] == 0
    four = spark.createDataFrame([(1, i, 0, v) for i, v in enumerate((1.0, 2.0, 4.0, 9.0))], rows.schema)
    assert depth.stats(four, 1.0, scale=1.0).first().p95_depth_m == 8.25
    two = spark.createDataFrame([(1, 0, 0, 1.0), (2, 0, 0, 3.0)], rows.schema)
    assert depth.summary(two, 1.0, scale=1.0).first().max_depth_m == 3.0
    assert depth.composite(two, "first").first().value == 1.0 and depth.composite(two, "last").first().value == 3.0


def test_hazard(spark):
    tiles = spark.createDataFrame([("A", "a", 10.0, 50.0, 11.0, 51.0), ("B", "b", 11.0, 50.0, 12.0, 51.0), ("D", "d", 30.0, 30.0, 31.0, 31.0)], tables.TILES)
    region = roi.from_bbox((10.5, 50.2, 11.5, 50.8))
    found = {r.return_period: r.n_tiles for r in hazard.catalogue(tiles, region).collect()}
    assert found == dict.fromkeys(hazard.RETURN_PERIODS, 2)
    assert hazard.catalogue(tiles, roi.from_bbox((0, 0, 1, 1))).count() == 0
    with pytest.raises(hazard.HazardError):
        hazard.return_periods(30)
    need = hazard.needed_files(tiles, region, [10, 20])
    part = need.where("NOT (return_period = 20 AND tile_id = 'B')")
    assert {r.return_period: r.complete for r in hazard.gate(need, part).collect()} == {10: True, 20: False}
    pixels = spark.createDataFrame([(10, 2, COL + 700, ROW - 500, 2.0), (10, 1, COL + 700, ROW - 500, -9999.0), (20, 1, COL + 700, ROW - 500, 1.0)], "return_period int, source long, col int, row int, value double")
    out = hazard.gated_mosaic(pixels, need, part, region).collect()
    assert [(r.return_period, r.value) for r in out] == [(10, 2.0)]
    with pytest.raises(hazard.HazardError):
        hazard.gated_mosaic(pixels, need, need.where("tile_id = 'A'"), region)


def test_listing_and_names(spark):
    name = "WD_MERGE_2020-02-15---2020-02-24_x_cluster_123.tif"
    page = f'<table><tr><td><a href="{name}">x</a></td><td>2020-01-01</td><td> 1.2G </td></tr><tr><td><a href="other.tif">y</a></td></tr></table>'
    row = inventory.listing(spark.createDataFrame([("2020", "u/2020/", page)], "year string, url string, html string")).collect()
    import hashlib

    assert len(row) == 1 and row[0].global_id == int.from_bytes(hashlib.sha1(name.encode()).digest()[:4], "big")
    assert (row[0].start_date, row[0].end_date, row[0].cluster_id, row[0].size_bytes) == ("2020-02-15", "2020-02-24", "123", int(1.2 * 2**30))
    sizes = spark.createDataFrame([("452M",), ("-",), ("2020-01-01",), (None,)], "s string").select(T.parse_size(F.col("s")).alias("b")).collect()
    assert [r.b for r in sizes] == [452 << 20, None, None, None]
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "global_id long, filename string")
    with pytest.raises(inventory.CollisionError):
        inventory.check_collisions(twice)


def test_region_search(spark):
    names = ["Nederland", "Oost-Nederland", "Gelderland", "Veluwe", "Deutschland", "Köln, Kreisfreie Stadt", "Valencia/València"]
    codes = ["NL", "NL2", "NL22", "NL221", "DE", "DEA23", "ES523"]
    rows = [(c, None, None, n, None) for c, n in zip(codes, names, strict=True)] + [("NLZZ", None, None, "Extra-Regio", None)]
    table = regions.complete_columns(spark.createDataFrame(rows, "NUTS_ID string, LEVL_CODE string, CNTR_CODE string, NAME_LATN string, NUTS_NAME string"))
    ask = lambda q, **k: [r.NUTS_ID for r in regions.search(table, q, **k).collect()]
    assert ask("nl2") == ["NL2", "NL22", "NL221"]
    assert ask("nederland") == ["NL", "NL2"]
    assert ask("Cologne") == ["DEA23"] and ask("koln") == ["DEA23"] and ask("València") == ["ES523"]
    assert ask("Gelderlnd") == ["NL22"] and ask("Atlantis") == []
    assert ask(None, level=0) == ["DE", "NL"] and "NLZZ" not in ask(None)
    assert ask(None, country="de") == ["DE", "DEA23"]


def test_ledger_ingest_and_verify(spark, tmp_path):
    lines = ['{"global_id":1,"filename":"a","download_status":"ok","process_status":"failed","points":0}', '{"global_id":1,"filename":"a","download_status":"ok","process_status":"complete","points":4}', '{"global_id":2,"filena']
    (tmp_path / "ledger.jsonl").write_text("\n".join(lines))
    ledger = tables.read_ledger(spark, str(tmp_path / "ledger.jsonl"))
    assert [(r.global_id, r.process_status) for r in inventory.latest(ledger).collect()] == [(1, "complete")]
    records = spark.createDataFrame([(i, "2020-01-01", None, "2020", "1", f"f{i}", f"u/f{i}") for i in (1, 2, 3)], tables.EVENTS)
    due = ingest.plan(records, ledger)
    assert {r.global_id for r in due.collect()} == {2, 3}
    pixels = spark.createDataFrame([(10.0, 49.99, 1.0, 2), (10.0, 49.99, 1.0, 1)], "lon double, lat double, value double, flood_id long")
    cells, log = ingest.run(due, pixels)
    assert [r.flood_id for r in cells.collect()] == [2]
    assert {r.global_id: (r.download_status, r.process_status) for r in log.collect()} == {2: ("ok", "complete"), 3: ("failed", None)}
    files = spark.createDataFrame([("a", 3, "x"), ("b", 3, "y"), ("c", 0, "z")], "filename string, size_bytes long, sha256 string")
    disk = spark.createDataFrame([("a", 3, "x"), ("b", 3, "?"), ("c", 0, "z")], files.schema)
    want = spark.createDataFrame([(x,) for x in "abcd"], "filename string")
    state = lambda deep: {r.filename: r.status for r in inventory.verify(want, disk, files, deep).collect()}
    assert state(False) == {"a": "present", "b": "present", "c": "corrupt", "d": "missing"}
    assert state(True)["b"] == "corrupt"
    merged = inventory.merge_mirror_ledger(files, disk.where("filename = 'b'"), "v1", "v1")
    assert {r.filename: r.sha256 for r in merged.collect()} == {"a": "x", "b": "?", "c": "z"}
    assert inventory.merge_mirror_ledger(files, disk.where("filename = 'b'"), "v1", "v2").count() == 1


def test_stream_appends_each_cell_once(spark, small, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for _ in range(2):
        small.unionByName(small).write.mode("append").parquet(source)
        stream.append_lake(stream.read_cells(spark, source), out, str(tmp_path / "state")).awaitTermination()
    assert tables.read_lake(spark, out).count() == small.distinct().count()


def test_places_and_exceedance(spark):
    lon, lat = grid.ORIGIN_X + (COL + 0.5) / 1200, grid.ORIGIN_Y - (ROW + 0.5) / 1200
    places = spark.createDataFrame([(1, lon, lat), (2, lon + 1, lat)], "place long, lon double, lat double")
    cells = spark.createDataFrame([(COL + 5, ROW, 1), (COL + 5, ROW + 5, 2), (COL + 40, ROW, 3)], tables.LAKE)
    assert {r.place: r.n_events for r in exposure.near_count(places, cells, 1000).collect()} == {1: 2, 2: 0}
    counts = spark.createDataFrame([(1, 2.0), (3, 5.0), (3, 1.0), (0, 9.0)], "n_events long, length_km double")
    assert {r.threshold: r.total for r in exposure.exceedance(counts).collect()} == {1: 8.0, 3: 6.0}


def test_places_in_the_far_north(spark):
    row = round((grid.ORIGIN_Y - 84.0) * 1200)
    lon, lat = grid.ORIGIN_X + (COL + 0.5) / 1200, grid.ORIGIN_Y - (row + 0.5) / 1200
    places = spark.createDataFrame([(k, lon + k / 1200, lat) for k in range(40)], "place long, lon double, lat double")
    cells = spark.createDataFrame([(COL + 80 + k, row, k) for k in range(200)], tables.LAKE)
    reach = 1000 / (111_320 / 1200 * math.cos(math.radians(lat)))  # in columns, about 103
    want = {p: sum(abs(80 + k - p) <= reach for k in range(200)) for p in range(40)}
    assert {r.place: r.n_events for r in exposure.near_count(places, cells, 1000).collect()} == want


def test_vector_files_and_legacy_dictionary(spark, tmp_path):
    (tmp_path / "t.geojson").write_text('{"features":[{"properties":{"id":"T","name":"n"},"geometry":{"type":"Polygon","coordinates":[[[10,50],[11,50],[11,51],[10,51],[10,50]]]}}]}')
    tile = tables.read_tiles(spark, str(tmp_path / "t.geojson")).first()
    assert (tile.tile_id, tile.minx, tile.miny, tile.maxx, tile.maxy) == ("T", 10, 50, 11, 51)
    (tmp_path / "d.json").write_text('{"schema_version":5,"combos":{"1":{"flood_ids":[10],"events":[{"global_id":10,"start_date":"2020-01-01"}]}}}')
    old = tables.read_legacy_dictionary(spark, str(tmp_path / "d.json"))
    assert (old.first().combo_id, old.first().flood_ids) == (1, [10])
    assert catalog.legacy_events(old, events(spark)).count() == 1


def test_ledger_runs_keep_their_order(spark, tmp_path):
    """Files are read by size and name; the run that wrote a line says which is the last."""
    path = str(tmp_path / "ledger")
    line = "global_id long, filename string, download_status string, process_status string, points long"
    tables.append_ledger(spark.createDataFrame([(1, "a", "ok", "complete", 5)], line), path)
    tables.append_ledger(spark.createDataFrame([(1, "a", "failed", None, 0)], line), path)
    tables.append_ledger(spark.createDataFrame([(k, "a" * 50, "ok", "complete", 7) for k in (1, 2, 3)], line).repartition(3), path)
    found = {r.global_id: (r.process_status, r.points) for r in inventory.latest(tables.read_ledger(spark, path)).collect()}
    assert found == {1: ("complete", 7), 2: ("complete", 7), 3: ("complete", 7)}


def test_a_rerun_leaves_no_cell_twice(spark, tmp_path):
    path = str(tmp_path / "lake")
    cells = spark.createDataFrame([(k, k % 3, 1 + k % 2, "2020") for k in range(20)], "col int, row int, flood_id long, year string")
    tables.write_lake(cells, path)
    tables.write_lake(cells.where("flood_id = 1"), path)
    want = sorted((r.col, r.row, r.flood_id) for r in cells.collect())
    assert sorted(map(tuple, tables.read_lake(spark, path).collect())) == want


def test_geojson_features(spark, tmp_path):
    import json

    ring = [[(10.0, 50.0), (11.0, 50.0), (11.0, 51.0), (10.0, 50.0)]]
    rows = spark.createDataFrame([(1, "a", ring), (2, "b", None)], f"event_id long, name string, geometry {tables.RINGS}")
    path = str(tmp_path / "c.geojson")
    tables.write_catalogue(rows, path)
    found = sorted((json.loads(r.value) for r in spark.read.text(path).collect()), key=lambda f: f["properties"]["event_id"])
    assert found[0] == {"type": "Feature", "properties": {"event_id": 1, "name": "a"}, "geometry": {"type": "Polygon", "coordinates": [[list(p) for p in ring[0]]]}}
    assert found[1] == {"type": "Feature", "properties": {"event_id": 2, "name": "b"}, "geometry": None}


def test_regions_of_a_long_snake_take_few_rounds(spark):
    """A region that winds through many rows: labels reach its least run in about the logarithm of its length."""
    rows = [(c, r, 1) for r in range(0, 200, 2) for c in range(8)] + [(7 if r % 4 == 1 else 0, r, 1) for r in range(1, 200, 2)] + [(20, 5, 1), (9, 9, 2)]
    found = recurrence.regions(spark.createDataFrame(rows, "col int, row int, combo_id long")).collect()
    assert sorted((r.combo_id, r.cells) for r in found) == [(1, 1), (1, 900), (2, 1)]
