"""Shapes as tables, unions, inputs of regions, crops and manifests, on small tables by hand and by brute force."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import grid
from tidemark.operators import catalog, depth, hazard, recurrence, regions, roi, shapes
from tidemark.operators import lake as lakes
from tidemark.plans import bundle, download, location

RES = grid.RESOLUTION
lon = lambda c: grid.ORIGIN_X + (c + 0.5) * RES
lat = lambda r: grid.ORIGIN_Y - (r + 0.5) * RES
RINGS = "shape string, rings array<array<struct<x:double,y:double>>>"


def at(c, r):
    """A point in the grid's units."""
    return grid.ORIGIN_X + c * RES, grid.ORIGIN_Y - r * RES


def square(spark, c0, r0, n):
    return spark.range(n * n).select((F.col("id") % n + c0).cast("int").alias("col"), (F.floor(F.col("id") / n) + r0).cast("int").alias("row"))


def test_cells_within_polygons_with_holes_and_beside_the_grid(spark):
    draw = random.Random(1)
    c0, r0 = 1020, 508  # over the border of a tile
    made = {}
    for k in range(12):
        ring = [at(c0 + draw.uniform(-5, 35), r0 + draw.uniform(-5, 35)) for _ in range(draw.randint(3, 9))]  # sides may cross
        hole = [at(c0 + draw.uniform(5, 20), r0 + draw.uniform(5, 20)) for _ in range(3)]
        made[f"s{k}"] = [ring, hole]
    made["none"], made["outside"] = [], [[(-179.0, -80.0), (-170.0, -80.0), (-175.0, -70.0)]]
    table = spark.createDataFrame([*made.items(), ("null", None)], RINGS)
    found = {(r.shape, r.col, r.row) for r in shapes.cells_within(square(spark, c0, r0, 30), table).collect()}
    want = {(k, c, r) for k, rings in made.items() for c in range(c0, c0 + 30) for r in range(r0, r0 + 30) if roi.point_inside(lon(c), lat(r), rings)}
    assert found == want and len(want) > 500
    assert {(r.col, r.row) for r in shapes.union_cells(square(spark, c0, r0, 30), table).collect()} == {(c, r) for _, c, r in want}


def test_lines_pass_the_cells_that_a_fine_walk_meets(spark):
    draw = random.Random(2)
    c0, r0 = 1010, 600
    lines = {k: (*at(c0 + draw.uniform(0, 30), r0 + draw.uniform(0, 30)), *at(c0 + draw.uniform(0, 30), r0 + draw.uniform(0, 30))) for k in range(10)}
    lines[10] = (*at(c0 + 2.5, r0 + 3.5), *at(c0 + 9.5, r0 + 3.5))  # along a row
    lines[11] = (*at(c0 + 2.5, r0 + 3.5), *at(c0 + 2.5, r0 + 9.5))  # along a column
    lines[12] = (*at(c0 + 4.5, r0 + 4.5), *at(c0 + 4.5, r0 + 4.5))  # a point
    table = spark.createDataFrame([(k, *v) for k, v in lines.items()], "shape int, x0 double, y0 double, x1 double, y1 double")
    strips = {}
    for s in shapes.line_strips(table).collect():
        strips.setdefault(s.shape, set()).update((c, s.row) for c in range(s["first"], s["last"] + 1))
    for k, (x0, y0, x1, y1) in lines.items():
        steps = 4000
        walk = {(math.floor((x0 + (x1 - x0) * t / steps - grid.ORIGIN_X) / RES), math.floor((grid.ORIGIN_Y - y0 - (y1 - y0) * t / steps) / RES)) for t in range(steps + 1)}
        assert walk <= strips[k] and len(strips[k] - walk) <= 1, k  # a walk may step over a corner
    cells = square(spark, c0, r0, 30).withColumn("flood_id", F.col("col").cast("long"))
    counts = {r.shape: r.n_events for r in shapes.line_counts(table, cells).collect()}
    assert counts[10] == 8 and counts[11] == 1 and counts[12] == 1
    nowhere = spark.createDataFrame([(1, 170.0, 10.0, 171.0, 10.0)], table.schema)
    assert [r.n_events for r in shapes.line_counts(nowhere, cells).collect()] == [0]


def test_rectangles_cover_strips_once(spark):
    draw = random.Random(3)
    strips = [(draw.randint(1, 2), draw.randint(0, 6), a, a + draw.randint(0, 5)) for a in (draw.randint(0, 12) for _ in range(40))]
    made = shapes.rectangles(spark.createDataFrame(strips, "k int, row int, first int, last int"), ["k"]).collect()
    covered = [(p.k, r, c) for p in made for r in range(p.min_row, p.max_row + 1) for c in range(p.min_col, p.max_col + 1)]
    assert len(covered) == len(set(covered))
    assert set(covered) == {(k, r, c) for k, r, a, b in strips for c in range(a, b + 1)}


def test_outlines_and_footprints_of_adjoining_combos(spark):
    lake = spark.createDataFrame([(10, 5, 1), (11, 5, 1), (11, 5, 2), (10, 6, 1), (11, 6, 1)], "col int, row int, flood_id long")
    cells = lakes.build_cells(lake)
    combos = lakes.number_combos(cells)
    parts = shapes.footprint_parts(lakes.build_pixel_combo(cells, combos), combos)
    assert {tuple(r) for r in parts.collect()} == {(1, 10, 11, 5, 6), (2, 11, 11, 5, 5)}  # event 1 is one rectangle over two combos
    ring = parts.where("event_id = 2").select(shapes.outline().alias("g")).first().g[0]
    assert ring[0] == ring[-1] and len(ring) == 5
    assert {(round(p.x, 9), round(p.y, 9)) for p in ring} == {tuple(round(v, 9) for v in at(c, r)) for c in (11, 12) for r in (5, 6)}


def test_regions_of_one_event(spark):
    lake = spark.createDataFrame([(1, 1, 7), (2, 1, 7), (2, 1, 8), (9, 9, 8)], "col int, row int, flood_id long")
    cells = lakes.build_cells(lake)
    combos = lakes.number_combos(cells)
    events = spark.createDataFrame([(7, "2001-01-01"), (8, "2003-01-01")], "global_id long, start_date string")
    found = recurrence.recurrence_regions(lakes.build_pixel_combo(cells, combos), combos, events, event_id=7).collect()
    assert sorted((r.cells, r["count"], r.when) for r in found) == [(1, 1, "2001-01-01"), (1, 1, "2001-2003")]


def test_a_union_keeps_what_its_shapes_share(spark):
    a, b = roi.from_bbox((*at(10, 30), *at(22, 18))), roi.from_bbox((*at(15, 25), *at(30, 10)))
    both = roi.union([a, b])
    many = roi.union([both, roi.from_rings([[at(12 + 8 * math.cos(t / 40), 12 + 8 * math.sin(t / 40)) for t in range(250)]])])
    for region in (both, many):
        found = {(r.col, r.row) for r in region.mask(square(spark, 0, 0, 40)).collect()}
        assert found == {(c, r) for c in range(40) for r in range(40) if any(roi.point_inside(lon(c), lat(r), s) for s in region.shapes)}
    assert both.key != roi.Roi(both.rings).key
    with pytest.raises(roi.RoiError):
        roi.union([])
    with pytest.raises(roi.RoiError):
        roi.union([a.buffered(10.0)])


def test_tiles_meet_the_shape_and_not_its_box(spark):
    tiles = spark.createDataFrame([(f"{i}_{j}", "t", float(i), float(j), i + 0.9, j + 0.9) for i in range(10) for j in range(10)], "tile_id string, name string, minx double, miny double, maxx double, maxy double")
    draw = random.Random(4)
    for _ in range(4):
        ring = [(draw.uniform(0, 10), draw.uniform(0, 10)) for _ in range(3)]
        found = {r.tile_id for r in hazard.touching(tiles, roi.from_rings([ring])).collect()}
        fine = {(math.floor(x), math.floor(y)) for x in (i / 40 for i in range(400)) for y in (j / 40 for j in range(400)) if x % 1 <= 0.9 and y % 1 <= 0.9 and roi.point_inside(x, y, [ring])}
        assert {f"{i}_{j}" for i, j in fine} <= found
        assert len(found) <= len(fine) + 6  # tiles that only a tip reaches are missed by the fine points
    holed = roi.from_rings([[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(2.95, 2.95), (6.95, 2.95), (6.95, 6.95), (2.95, 6.95)]])
    assert {r.tile_id for r in hazard.touching(tiles, holed).collect()} == {f"{i}_{j}" for i in range(10) for j in range(10) if not (3 <= i <= 6 and 3 <= j <= 6)}
    assert {r.tile_id for r in hazard.touching(tiles, roi.resolve(point=(5.5, 5.5), radius_m=1000.0)).collect()} == {"5_5"}


@pytest.fixture(scope="module")
def boundaries(spark):
    ring = lambda x: [[(x, 50.0), (x + 1.0, 50.0), (x + 1.0, 51.0), (x, 51.0)]]
    rows = [("DE1", 1, "DE", "Köln", "Köln", ring(6.0)), ("DE11", 2, "DE", "Köln", "Köln", ring(6.5)), ("ES5", 1, "ES", "Valencia/València", "Valencia", ring(1.0)), ("FR1", 1, "FR", "Nowhere", "Nowhere", None)]
    return spark.createDataFrame(rows, "NUTS_ID string, LEVL_CODE int, CNTR_CODE string, NAME_LATN string, NUTS_NAME string, rings array<array<struct<x:double,y:double>>>")


def test_inputs_of_a_region(spark, boundaries, tmp_path):
    where = lambda **k: location.locate(spark, boundaries=boundaries, **k)
    assert where(region="Cologne").bounds == (6.0, 50.0, 7.5, 51.0)  # both levels, by an exonym
    assert where(region="koln", level=2).bounds == (6.5, 50.0, 7.5, 51.0)
    assert where(region="valenciaa, Spain").bounds[0] == 1.0  # one letter more
    assert where(nuts="es5 ").bounds == where(nuts=["ES5", "es5"]).bounds == (1.0, 50.0, 2.0, 51.0)
    for odd in ({"region": "Atlantis"}, {"nuts": "XX1"}, {"nuts": []}):
        with pytest.raises(regions.PlaceError):
            where(**odd)
    for odd in ({}, {"region": "koln", "bbox": (0, 0, 1, 1)}, {"nuts": "FR1"}):
        with pytest.raises(roi.RoiError):
            where(**odd)
    with pytest.raises(location.CRSError):
        where(nuts="ES5", crs=3035)
    box = [[[4.0, 50.0], [5.0, 50.0], [5.0, 51.0], [4.0, 51.0], [4.0, 50.0]]]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": n}, "geometry": {"type": "Polygon", "coordinates": [[[x + d, y] for x, y in box[0]]]}} for n, d in (("a", 0.0), ("b", 0.5))]}
    (tmp_path / "v.geojson").write_text(json.dumps(doc))
    drawn = where(vector_file=str(tmp_path / "v.geojson"))
    assert drawn.bounds == (4.0, 50.0, 5.5, 51.0) and len(drawn.shapes) == 2
    assert where(vector_file=str(tmp_path / "v.geojson"), shape="hull", buffer_m=100.0).buffer_m == 100.0


def test_downloads_are_crops_with_paths(spark, tmp_path):
    region = roi.from_bbox((*at(10, 30), *at(30, 10)))
    pixels = spark.createDataFrame([(1, 12, 12, 40.0), (1, 13, 12, 0.0), (1, 50, 50, 9.0), (2, 60, 60, 5.0), (3, 15, 15, 7.0)], "raster_id long, col int, row int, value double")
    catalogue = spark.createDataFrame([(k, f"2001-01-0{k}", f"f{k}.tif", f"u{k}") for k in (1, 2, 3)], "event_id long, date string, filename string, download_url string")
    path = str(tmp_path / "crops")
    got = {r.event_id: r.path for r in download.download(catalogue.where("event_id < 3"), pixels, region, path).collect()}
    assert got[1].endswith(f"crop=flood_2001-01-01_id1_{region.key}.tif") and got[2] is None  # nothing valid of 2 lies inside
    again = download.download(catalogue, pixels.withColumn("value", F.col("value") + 1), region, path)
    assert again.where("path IS NOT NULL").count() == catalog.has_path(again).count() == 2
    assert {(r.raster_id, r.value) for r in spark.read.parquet(path).collect()} == {(1, 40.0), (3, 8.0)}  # what is there stays
    download.download(catalogue.where("event_id = 1"), pixels, region, path, force=True)
    assert spark.read.parquet(path).count() == 2
    download.write_composite(pixels, str(tmp_path / "whole"))
    assert spark.read.parquet(str(tmp_path / "whole")).count() == 4
    assert download.download(catalogue.limit(0), pixels, region, str(tmp_path / "none")).count() == 0
    periods = spark.createDataFrame([(10, "h10.tif"), (20, "h20.tif")], "return_period int, filename string")
    need = spark.createDataFrame([(10, "a"), (20, "b")], "return_period int, filename string")
    modelled = pixels.select(F.when(F.col("raster_id") == 1, 10).otherwise(20).alias("return_period"), F.col("raster_id").alias("source"), "col", "row", "value")
    made = download.download(periods, modelled, region, str(tmp_path / "h"), need, need.where("filename = 'a'"))
    assert {r.return_period: bool(r.path) for r in made.collect()} == {10: True, 20: False}
    with pytest.raises(hazard.HazardError):
        download.download(periods, modelled, region, path)


def test_guard_paths_and_medians(spark):
    many = spark.range(5).select(F.col("id").alias("event_id"), F.lit("2001-01-01").alias("date"))
    with pytest.raises(depth.DepthError):
        depth.guarded(many)
    assert [r.event_id for r in depth.guarded(many, 2).collect()] == [0, 1] and depth.guarded(many.limit(4)).count() == 4
    rows = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 2.0)], "year string, v double")
    assert {tuple(r) for r in catalog.median_by(rows, "year", "v").collect()} == {("a", 2, 2.5), ("b", 1, 2.0)}
    assert catalog.has_path(spark.createDataFrame([("x",), (None,), (" ",), ("NaN",)], "path string")).count() == 1


def test_outcomes_tell_five_cases_apart(spark):
    asked = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False), (5, True), (6, None)], "flood_id long, has_crs boolean")
    pixels = spark.createDataFrame([(1, 1, 9.0, 1), (2, 2, 0.0, 2), (1, 1, 9.0, 4), (1, 2, 9.0, 5), (1, 1, 9.0, 6)], "col int, row int, value double, flood_id long")
    cached = spark.createDataFrame([(5, 3)], "flood_id long, points long")
    want = {1: ("complete", 1), 2: ("empty", 0), 3: ("missing_file", 0), 4: ("missing_crs", 0), 5: ("cached", 3), 6: ("missing_crs", 0)}
    assert {r.flood_id: (r.status, r.points) for r in lakes.outcomes(asked, pixels, cached).collect()} == want


def test_manifests(spark, tmp_path):
    tiles = spark.createDataFrame([("1", "N1")], "tile_id string, name string")
    made = hazard.manifest(tiles, "https://archive.example/", before={"mirror": [1], "old": 2})
    assert made["mirror"] == [1] and "old" not in made and made["provenance"]["n_tiles"] == 1
    lake = spark.createDataFrame([(1, 1, 7), (2, 1, 7)], "col int, row int, flood_id long")
    path = str(tmp_path / "index")
    bundle.build(lake, path)
    with pytest.raises(bundle.ManifestError):
        bundle.validate_publication(spark, path)
    files = bundle.seal(spark, path)["files"]
    bundle.validate_publication(spark, path, verify_checksums=True)
    name = sorted(files)[0]
    (tmp_path / "index" / name).unlink()
    with pytest.raises(bundle.ManifestError, match="missing"):
        bundle.validate_publication(spark, path, verify_checksums=True)
