"""The command line against a small index, with its exit codes."""

import json

from tidemark import cli
from tidemark.plans import bundle


def test_commands(spark, tmp_path, capsys):
    lake = spark.createDataFrame([(63500 + k, 39500, 7) for k in range(30)], "col int, row int, flood_id long")
    events = spark.createDataFrame([(7, "2001-01-01", "2001-01-03", "2001", "1", "f", "u")], "global_id long, start_date string, end_date string, year string, cluster_id string, filename string, download_url string")
    path, doc = str(tmp_path / "index"), tmp_path / "b.geojson"
    bundle.build(lake, path, events)
    ring = [[6.0, 52.0], [7.0, 52.0], [7.0, 53.0], [6.0, 53.0], [6.0, 52.0]]
    doc.write_text(json.dumps({"features": [{"properties": {"NUTS_ID": "NL1", "NAME_LATN": "Deventer"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}))
    place = ["--region", "deventer", "--boundaries", str(doc)]
    for name in ("floods", "footprints", "recurrence"):
        assert cli.main([name, "--index", path, *place]) == 0
        assert "2001-01-01" in capsys.readouterr().out
    assert cli.main(["floods", "--index", path, "--vector-file", str(doc)]) == 0
    assert cli.main(["floods", "--index", path, "--region", "atlantis", "--boundaries", str(doc)]) == 2
    assert cli.main(["floods", "--index", path]) == 2
    assert cli.main(["check", "--index", path]) == 5
    assert cli.main(["seal", "--index", path]) == 0
    assert cli.main(["check", "--index", path]) == 0
    files = tmp_path / "files"
    files.mkdir()
    (files / "f").write_bytes(b"abc")
    events.selectExpr("global_id", "start_date", "end_date", "year", "cluster_id", "filename", "download_url", "3L AS size_bytes").write.csv(str(tmp_path / "inv"), header=True)
    (tmp_path / "ledger.json").write_text('{"filename": "f", "size_bytes": 3, "sha256": "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"}')
    capsys.readouterr()
    assert cli.main(["verify", "--inventory", str(tmp_path / "inv"), "--files", str(files), "--ledger", str(tmp_path / "ledger.json"), "--deep"]) == 0
    assert "present" in capsys.readouterr().out


def test_from_rasters_to_crops(spark, tmp_path, capsys):
    """Files are ingested, indexed, asked, cropped and copied; a rerun that finds an event dry takes its cells away."""
    import numpy as np

    from tests.test_rasters import plain

    archive = tmp_path / "archive"
    archive.mkdir()
    values = np.zeros((12, 12), dtype=np.uint16)
    values[2:9, 3:9] = 150
    values[4, 5] = 0  # a hole
    names = {1: "one.tif", 2: "two.tif", 3: "lost.tif"}
    for k in (1, 2):
        (archive / names[k]).write_bytes(plain(values * (k == 1), 6.2, 52.15, 1 / 1200, 1 / 1200, 4326))
    rows = [(k, "2020-05-01", "2020-05-03", "2020", "1", n, f"http://x/{n}", (archive / n).stat().st_size if k < 3 else 5) for k, n in names.items()]
    spark.createDataFrame(rows, "global_id long, start_date string, end_date string, year string, cluster_id string, filename string, download_url string, size_bytes long").write.csv(str(tmp_path / "inv"), header=True)
    at = {k: str(tmp_path / k) for k in ("inv", "lake", "ledger", "index", "crops", "copy", "book", "out.geojson", "m")}
    ingest = ["ingest", "--rasters", str(archive), "--inventory", at["inv"], "--lake", at["lake"], "--ledger", at["ledger"]]
    assert cli.main(ingest) == 0
    told = capsys.readouterr().out
    assert "complete" in told and "empty" in told and "failed" in told
    assert cli.main(["build-index", "--lake", at["lake"], "--index", at["index"], "--inventory", at["inv"]]) == 0
    box = ["--bbox", "6.0", "52.0", "7.0", "53.0"]
    assert cli.main(["--out", at["out.geojson"], "polygons", "--index", at["index"], *box]) == 0
    drawn = [json.loads(r.value) for r in spark.read.text(at["out.geojson"]).collect()]
    assert [(f["properties"]["cells"], f["properties"]["holes"], len(f["geometry"]["coordinates"][0])) for f in drawn] == [(41, 1, 2)]
    assert cli.main(["download", "--index", at["index"], "--rasters", str(archive), "--inventory", at["inv"], "--to", at["crops"], *box]) == 0
    assert spark.read.parquet(at["crops"]).count() == 41
    mirror = ["mirror", "--inventory", at["inv"], "--source", str(archive), "--target", at["copy"], "--ledger", at["book"]]
    assert cli.main([*mirror, "--dry-run"]) == 0 and not (tmp_path / "copy").exists()
    assert cli.main(mirror) == 0
    assert {p.name for p in (tmp_path / "copy").iterdir()} == {"one.tif", "two.tif"}
    tiles = tmp_path / "t.geojson"
    tiles.write_text(json.dumps({"features": [{"properties": {"id": "A", "name": "N"}, "geometry": {"type": "Polygon", "coordinates": [[[6, 52], [7, 52], [7, 53], [6, 52]]]}}]}))
    assert cli.main(["hazard-manifest", "--tiles", str(tiles), "--base-url", "http://h/", "--to", at["m"]]) == 0
    assert bundle.read_json(spark, at["m"])["provenance"]["n_tiles"] == 1

    from pyspark.sql import functions as F

    from tidemark.sources import tables

    asked = spark.createDataFrame([(1,)], "flood_id long")
    cells = tables.read_lake(spark, at["lake"]).where("flood_id = 9").withColumn("year", F.lit(2020))
    tables.write_lake(cells, at["lake"], asked)
    assert not list((tmp_path / "lake").rglob("event=1"))


def test_stream_gives_changed_cells_all_their_events(spark, tmp_path):
    from tidemark.sources import tables
    from tidemark.streaming import cells

    known = spark.createDataFrame([(1, 1, 5), (2, 2, 5)], tables.LAKE)
    spark.createDataFrame([(1, 1, 6), (3, 3, 6)], tables.LAKE).write.parquet(str(tmp_path / "new"))
    found = []
    cells.refresh_cells(cells.read_cells(spark, str(tmp_path / "new")), lambda df: found.extend(df.collect()), str(tmp_path / "c"), lambda: known).awaitTermination()
    assert {(r.col, tuple(r.flood_ids)) for r in found} == {(1, (5, 6)), (3, (6,))}
