"""Copies between roots, and geometry in files."""

import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.operators import inventory
from tidemark.plans import mirror
from tidemark.sources import geometry, tables


def test_mirror_goes_on_where_it_was_cut_off(spark, tmp_path):
    source, target, book = tmp_path / "archive", tmp_path / "copy", str(tmp_path / "ledger")
    (source / "2020").mkdir(parents=True)
    for k in range(12):
        (source / "2020" / f"f{k}.tif").write_bytes(os.urandom(1000 + k))
    wanted = mirror.listing(spark, str(source), deep=True)
    assert {r.filename for r in wanted.collect()} == {f"2020/f{k}.tif" for k in range(12)}
    wanted = wanted.unionByName(spark.createDataFrame([("2020/gone.tif", 5, None)], wanted.schema))

    how = {"attempts": 2, "wait_s": 0.01, "files_a_task": 3}
    half = wanted.where("filename < '2020/f4'")  # f0, f1, f10, f11, f2, f3
    mirror.mirror(spark, half, str(source), str(target), book, **how)
    (target / "2020" / "f4.tif.abc.part").write_bytes(b"half a file")
    (target / "2020" / "f2.tif").write_bytes(b"cut")  # another size than the ledger says
    before = os.stat(target / "2020" / "f0.tif").st_mtime_ns
    lines = {r.filename: r for r in mirror.mirror(spark, wanted, str(source), str(target), book, **how).collect()}
    assert {k: r.status for k, r in lines.items()} == {f"2020/f{k}.tif": "copied" for k in range(12)} | {"2020/gone.tif": "failed"}
    assert lines["2020/gone.tif"].attempts == 2 and lines["2020/gone.tif"].error
    assert os.stat(target / "2020" / "f0.tif").st_mtime_ns == before  # not copied twice
    for k in range(12):
        assert (target / "2020" / f"f{k}.tif").read_bytes() == (source / "2020" / f"f{k}.tif").read_bytes()
    told = inventory.verify(wanted.where("filename <> '2020/gone.tif'"), mirror.listing(spark, str(target), deep=True), mirror.ledger(spark, book).where("status = 'copied'"), deep=True)
    assert {r.status for r in told.collect()} == {"present"}


def test_a_copy_with_another_checksum_has_no_name(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.tif").write_bytes(b"right")
    wanted = spark.createDataFrame([("x.tif", 5, "0" * 64)], "filename string, size_bytes long, sha256 string")
    found = mirror.mirror(spark, wanted, str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "l"), attempts=1).collect()
    assert [r.status for r in found] == ["failed"] and list((tmp_path / "b").iterdir()) == []
    assert mirror.mirror(spark, wanted.where("false"), str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "l")).count() == 0


def test_binary_of_polygons(spark):
    ring = [(0.0, 0.0), (2.0, 0.0), (0.0, 2.0)]
    hole = [(0.5, 0.5), (0.5, 0.75), (0.75, 0.5), (0.5, 0.5)]
    point = lambda p: {"x": p[0], "y": p[1]}
    rows = [(1, [list(map(point, ring)), list(map(point, hole))]), (2, None), (3, [])]
    table = spark.createDataFrame(rows, f"id int, rings {geometry.RINGS}")
    want = struct.pack("<BII", 1, 3, 2) + struct.pack("<I8d", 4, 0, 0, 2, 0, 0, 2, 0, 0) + struct.pack("<I8d", 4, 0.5, 0.5, 0.5, 0.75, 0.75, 0.5, 0.5, 0.5)
    found = {r.id: r for r in table.select("id", geometry.wkb(F.col("rings")).alias("w"), geometry.polygons(geometry.wkb(F.col("rings"))).alias("p")).collect()}
    assert bytes(found[1].w) == want and found[2].w is None and found[2].p is None
    assert [[(p.x, p.y) for p in r] for r in found[1].p[0]] == [[*ring, ring[0]], hole]
    big = struct.pack(">BII", 0, 6, 1) + struct.pack(">BII", 0, 3, 1) + struct.pack(">I4d", 2, 1, 2, 3, 4)
    back = spark.createDataFrame([(bytearray(big),)], "w binary").select(geometry.polygons(F.col("w")).alias("p")).first().p
    assert [(p.x, p.y) for p in back[0][0]] == [(1.0, 2.0), (3.0, 4.0)]


@pytest.mark.parametrize("several", [False, True])
def test_geometry_in_parquet(spark, tmp_path, several):
    shape = [[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 3.0}, {"x": 0.0, "y": 0.0}]]
    name, kind = ("polygons", geometry.POLYGONS) if several else ("geometry", geometry.RINGS)
    table = spark.createDataFrame([(1, [shape] if several else shape), (2, None)], f"event_id int, {name} {kind}")
    tables.write_catalogue(table, str(tmp_path / "out.parquet"))
    found = {r.event_id: r.polygons for r in geometry.read_geoparquet(spark, str(tmp_path / "out.parquet")).collect()}
    assert found[2] is None and [(p.x, p.y) for p in found[1][0][0]] == [(0, 0), (1, 0), (1, 3), (0, 0)]
    raw = spark.read.parquet(str(tmp_path / "out.parquet")).where("bbox.xmax >= 1").first()
    assert tuple(raw.bbox) == (0.0, 0.0, 1.0, 3.0)
    told = json.loads((tmp_path / "out.parquet" / "_geo.json").read_text())
    assert told["columns"]["geometry"]["encoding"] == "WKB"
