"""GeoTIFF files of all kinds written byte by byte, and read as pixel tables."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import grid
from tidemark.operators import depth, lake
from tidemark.sources import rasters


def plain(values, west, north, dx, dy, epsg, nodata=0.0, rows=None, kind=None, compression=1):
    rows = rows or len(values)
    kind = kind or values.dtype.kind + str(values.dtype.itemsize)
    parts = [np.ascontiguousarray(values[k : k + rows]).astype("<" + kind).tobytes() for k in range(0, len(values), rows)]
    pack = {1: lambda b: b, 8: zlib.compress}[compression]
    return rasters.assemble([pack(p) for p in parts], values.shape[1], len(values), rows, west, north, dx, dy, epsg, nodata, kind, compression)


def files(spark, found):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in found.items()], "raster string, content binary")


def diagonal():
    return np.eye(10, dtype=np.uint8)


def test_diagonal_raster_to_cells(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "flood.tif").write_bytes(plain(diagonal(), 10.0, 50.0, 0.01, 0.01, 4326))
    (tmp_path / "a" / "notes.txt").write_text("x")
    read = rasters.read_files(spark, str(tmp_path))
    head = rasters.headers(read).collect()
    assert [(r.raster, r.error, r.width, r.height, r.dtype, r.epsg, r.nodata, r.affine) for r in head] == [("flood.tif", None, 10, 10, "u1", 4326, 0.0, [10.0, 0.01, 0.0, 50.0, 0.0, -0.01])]
    ids = spark.createDataFrame([("flood.tif", 7)], "raster string, flood_id long")
    cells = lake.pixels_to_lake(rasters.lake_pixels(rasters.pixels(read), ids)).collect()
    want = {(math.floor((10.0 + 0.01 * (k + 0.5) - grid.ORIGIN_X) / grid.RESOLUTION), math.floor((grid.ORIGIN_Y - (50.0 - 0.01 * (k + 0.5))) / grid.RESOLUTION), 7) for k in range(10)}
    assert set(map(tuple, cells)) == want


def test_depth_raster_in_metres(spark):
    values = np.zeros((20, 20), dtype=np.float32)
    values[8:12, 8:12] = 2.5
    found = files(spark, {"d.tif": plain(values, 3_200_000.0, 2_000_000.0, 100.0, 100.0, 3035, rows=7)})
    pixels = rasters.pixels(found)
    area = rasters.statistics_area(rasters.headers(found).first())
    told = depth.stats(pixels.withColumnRenamed("raster", "raster_id"), area, scale=1.0).first()
    assert (told.n_pixels, told.max_depth_m, told.mean_depth_m, told.p95_depth_m) == (16, 2.5, 2.5, 2.5)
    assert (told.area_km2, told.volume_m3, told.volume_mm3) == (0.16, 400_000.0, 0.4)
    from tidemark.functions.projections import PLAIN, project

    for r in pixels.collect():
        assert (r.x, r.y) == (3_200_000 + (r.col + 0.5) * 100, 2_000_000 - (r.row + 0.5) * 100)
        assert project(r.lon, r.lat, 3035, PLAIN) == pytest.approx((r.x, r.y), abs=1e-3)


def test_tile_of_the_source_projection(spark):
    values = np.zeros((10, 10), dtype=np.uint16)
    values[5, 5] = 150
    found = files(spark, {"equi7.tif": plain(values, 7_950_000, 1_060_000, 20, 20, 27704)})
    ids = spark.createDataFrame([("equi7.tif", 5)], "raster string, flood_id long")
    cells = lake.pixels_to_lake(rasters.lake_pixels(rasters.pixels(found), ids)).collect()
    assert len(cells) == 1 and cells[0].flood_id == 5


def big_tiff(values, predictor, compression, order=">", tile=16):
    """A tiled file of 64-bit offsets."""
    kind = np.dtype(values.dtype).newbyteorder(order)
    high, wide = values.shape
    parts = []
    for y in range(0, high, tile):
        for x in range(0, wide, tile):
            part = np.zeros((tile, tile), values.dtype)
            cut = values[y : y + tile, x : x + tile]
            part[: cut.shape[0], : cut.shape[1]] = cut
            if predictor == 2:
                part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
            raw = part.astype(kind).tobytes()
            if predictor == 3:
                planes = np.frombuffer(part.astype(np.dtype(values.dtype).newbyteorder(">")).tobytes(), np.uint8).reshape(tile, tile, -1).transpose(0, 2, 1).reshape(tile, -1)
                raw = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).astype(np.uint8).tobytes()
            if compression == 8:
                raw = zlib.compress(raw)
            elif compression == 50000:
                zstandard = pytest.importorskip("zstandard")
                raw = zstandard.ZstdCompressor().compress(raw)
            elif compression == 5:
                raw = lzw(raw)
            parts.append(raw)
    offsets, at = [], 16
    for p in parts:
        offsets.append(at)
        at += len(p)
    n = len(parts)
    tags = [
        (256, 4, 1, [wide]), (257, 4, 1, [high]), (258, 3, 1, [values.dtype.itemsize * 8]), (259, 3, 1, [compression]), (277, 3, 1, [1]), (317, 3, 1, [predictor]), (322, 3, 1, [tile]), (323, 3, 1, [tile]),
        (324, 16, n, offsets), (325, 16, n, [len(p) for p in parts]), (339, 3, 1, [{"u": 1, "i": 2, "f": 3}[values.dtype.kind]]), (34264, 12, 16, [0.5, 0, 0, 10.0, 0, -0.25, 0, 50.0] + [0.0] * 8), (34735, 3, 8, [1, 1, 0, 1, 2048, 0, 1, 4326]),
    ]
    more, table, rest = at + 8 + 20 * len(tags) + 8, b"", b""
    for tag, t, count, v in tags:
        raw = struct.pack(f"{order}{count}{rasters._TYPES[t]}", *v)
        if len(raw) <= 8:
            table += struct.pack(order + "HHQ", tag, t, count) + raw.ljust(8, b"\0")
        else:
            table += struct.pack(order + "HHQQ", tag, t, count, more + len(rest))
            rest += raw
    return (b"MM" if order == ">" else b"II") + struct.pack(order + "HHHQ", 43, 8, 0, at) + b"".join(parts) + struct.pack(order + "Q", len(tags)) + table + struct.pack(order + "Q", 0) + rest


def lzw(raw):
    table, bits, last = {bytes([k]): k for k in range(256)}, [], b""
    put = lambda code: bits.append((code, 9 if len(table) + 2 < 512 else 10 if len(table) + 2 < 1024 else 11 if len(table) + 2 < 2048 else 12))
    put(256)
    for k in raw:
        word = last + bytes([k])
        if word in table:
            last = word
            continue
        put(table[last])
        table[word] = len(table) + 2
        last = bytes([k])
        if len(table) + 2 >= 4094:
            put(256)
            table = {bytes([k]): k for k in range(256)}
    put(table[last])
    put(257)
    number = size = 0
    for code, width in bits:
        number, size = number << width | code, size + width
    return (number << -size % 8).to_bytes(-(-size // 8), "big")


@pytest.fixture(scope="module")
def odd():
    r = np.random.default_rng(3)
    whole = (r.random((37, 45)) * 900).astype(np.uint16) * (r.random((37, 45)) < 0.5)
    real = (r.random((37, 45)) * 9).astype(np.float32)
    return {
        "u2_none_be.tif": (whole, big_tiff(whole, 1, 1)), "u2_diff_zip.tif": (whole, big_tiff(whole, 2, 8, "<")), "f4_float_zstd.tif": (real, big_tiff(real, 3, 50000, "<")),
        "u2_lzw.tif": (whole, big_tiff(whole, 1, 5, "<")), "i2_diff_be.tif": (whole.astype(np.int16), big_tiff(whole.astype(np.int16), 2, 8)),
        "strips.tif": (real, plain(real, 10.0, 50.0, 0.5, 0.25, 4326, rows=8, compression=8)),
    }


def test_layouts_codecs_and_predictors(spark, odd):
    found = rasters.pixels(files(spark, {k: v for k, (_, v) in odd.items()}), dry=False).collect()
    for name, (values, _) in odd.items():
        got = {(r.col, r.row): r.value for r in found if r.raster == name}
        assert got == {(c, w): float(values[w, c]) for w, c in np.argwhere(values != 0)}, name
        assert all((r.lon, r.lat) == pytest.approx((10 + (r.col + 0.5) * 0.5, 50 - (r.row + 0.5) * 0.25)) for r in found if r.raster == name)


def test_files_that_are_no_rasters(spark, odd):
    good = odd["strips.tif"][1]
    bad = {"none.tif": b"", "text.tif": b"hello, this is text", "cut.tif": good[:200], "half.tif": good[: len(good) // 2], "here.tif": good, "lost.tif": plain(diagonal(), 0, 0, 1, 1, 0), "far.tif": plain(diagonal(), 0, 0, 1, 1, 28992)}
    table = files(spark, bad).union(spark.createDataFrame([("null.tif", None)], "raster string, content binary"))
    told = {r.raster: r for r in rasters.headers(table).collect()}
    assert {k for k, r in told.items() if r.error} == {"none.tif", "text.tif", "cut.tif", "half.tif", "null.tif"}
    assert told["lost.tif"].epsg is None and told["far.tif"].epsg == 28992
    found = rasters.pixels(table)
    assert {r.raster for r in found.where("lon IS NOT NULL").select("raster").distinct().collect()} == {"here.tif"}
    assert found.where("raster = 'lost.tif'").count() == 10
    assert rasters.pixels(table.where("false")).count() == 0


def test_encoded_rasters_come_back(spark):
    rows = spark.range(5000).select((F.col("id") % 3).cast("string").alias("raster"), (F.col("id") * 7 % 300).cast("int").alias("col"), (F.col("id") * 11 % 400).cast("int").alias("row"), (F.col("id") % 50 + 1).cast("double").alias("value"))
    made = rasters.encode(rows, -46.8, 85.1, 1 / 1200, stripe=64).repartition(2)
    want = {(r.raster, r.col, r.row): r.value for r in rows.groupBy("raster", "col", "row").agg(F.max("value").alias("value")).collect()}
    low = {r.raster: (r.c, r.w) for r in rows.groupBy("raster").agg(F.min("col").alias("c"), F.min("row").alias("w")).collect()}
    found = rasters.pixels(made).collect()
    assert {(r.raster, r.col + low[r.raster][0], r.row + low[r.raster][1]): r.value for r in found} == want
    assert all(math.floor((r.lon + 46.8) * 1200) == r.col + low[r.raster][0] for r in found)


@pytest.mark.parametrize(("epsg", "west", "north", "step"), [(4326, 6.0, 52.5, 0.01), (3035, 4_000_000.0, 3_300_000.0, 1000.0), (27704, 4_600_000.0, 2_200_000.0, 1000.0), (32632, 300_000.0, 5_800_000.0, 1000.0)])
def test_bounds_read_their_blocks_only(spark, epsg, west, north, step):
    values = np.ones((96, 80), dtype=np.uint8)
    found = files(spark, {"a.tif": plain(values, west, north, step, step, epsg, rows=4), "far.tif": plain(values, 0.0, 10.0, 0.01, 0.01, 4326)})
    whole = rasters.pixels(found.where("raster = 'a.tif'"))
    middle = whole.agg(F.avg("lon").alias("x"), F.avg("lat").alias("y")).first()
    box = (middle.x - 0.05, middle.y - 0.03, middle.x + 0.06, middle.y + 0.02)
    at = lambda df: sorted((r.raster, r.col, r.row) for r in df.collect())
    assert at(rasters.pixels(found, within=box)) == at(whole.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3])))
    assert len(at(rasters.pixels(found, within=box))) > 20
    assert 0 < rasters.blocks(found, box).count() < 14 < rasters.blocks(found).count()
