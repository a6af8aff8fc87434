"""Command line: build an index, ask it, check it. `python -m tidemark.cli --help`."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tidemark.functions.projections import SUPPORTED, CRSError
from pyspark.sql import functions as F

from tidemark.operators import catalog, hazard, inventory, outlines, recurrence, regions, roi
from tidemark.plans import bundle, download, ingest, location, mirror
from tidemark.sources import rasters, tables

BOUNDARIES = "NUTS_ID:string,LEVL_CODE:string,CNTR_CODE:string,NAME_LATN:string,NUTS_NAME:string"
#: Exit codes by kind of error.
CODES = ((roi.RoiError, 2), (CRSError, 2), (regions.PlaceError, 2), (hazard.HazardError, 3), (bundle.IndexMissingError, 4), (bundle.ManifestError, 5))


#: Rows that are shown without --out.
SHOWN = 20


def _region(spark, a) -> roi.Roi:
    boundaries = regions.complete_columns(tables.read_features(spark, a.boundaries, BOUNDARIES)) if a.boundaries else None
    return location.locate(
        spark, region=a.region, nuts=a.nuts, vector_file=a.vector_file, point=a.point, bbox=a.bbox, radius_m=a.radius, level=a.level, boundaries=boundaries,
        buffer_m=a.buffer, crs=a.crs, shape=a.shape,
    )


def _floods(spark, a):
    index, combos, events = bundle.open_index(spark, a.index)
    return catalog.floods(index, combos, events, _region(spark, a), a.year, a.start, a.end)


def _footprints(spark, a):
    index, combos, events = bundle.open_index(spark, a.index)
    return recurrence.footprints(_region(spark, a).mask(index), combos, events)


def _recurrence(spark, a):
    index, combos, events = bundle.open_index(spark, a.index)
    return recurrence.recurrence_regions(_region(spark, a).mask(index), combos, events, a.event)


def _polygons(spark, a):
    index, combos, events = bundle.open_index(spark, a.index)
    found = outlines.footprint_polygons(_region(spark, a).mask(index), combos)
    return events.select(F.col("global_id").alias("event_id"), F.col("start_date").alias("date"), "end_date", "filename").join(found, "event_id")


def _rasters(spark, path, inventory_path, within=None):
    """(records, pixels with their event) of the raster files that an inventory names, of all of them or within bounds in degrees."""
    records = tables.read_inventory(spark, inventory_path)
    ids = records.select(F.col("filename").alias("raster"), F.col("global_id").alias("flood_id"))
    return records, rasters.pixels(rasters.read_files(spark, path), within=within).join(ids, "raster")


def _ingest(spark, a):
    records, pixels = _rasters(spark, a.rasters, a.inventory)
    try:
        before = tables.read_ledger(spark, a.ledger)
        before.schema  # noqa: B018  # an absent ledger is told here
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        before = spark.createDataFrame([], tables.LEDGER + ", line long")
    due = ingest.plan(records, before, year=a.year, limit=a.limit)
    known = F.coalesce(F.col("epsg").isin(*SUPPORTED), F.lit(False)) & F.col("affine").isNotNull()
    heads = rasters.headers(rasters.read_files(spark, a.rasters)).where("error IS NULL").select(F.col("raster").alias("filename"), known.alias("has_crs"))
    files = heads.join(records.select("filename", F.col("global_id").alias("flood_id")), "filename")
    cells, lines = ingest.run(due, pixels.where("lon IS NOT NULL").select("lon", "lat", "value", "flood_id"), a.max_depth, files)
    tables.write_lake(cells, a.lake, due.select(F.col("global_id").alias("flood_id")))
    tables.append_ledger(lines.withColumn("last_error", F.lit(None).cast("string")), a.ledger)
    return inventory.outcomes(inventory.latest(tables.read_ledger(spark, a.ledger)))


def _download(spark, a):
    region = _region(spark, a)
    found = catalog.floods(*bundle.open_index(spark, a.index), region, a.year, a.start, a.end)
    _, pixels = _rasters(spark, a.rasters, a.inventory, region.bounds)
    on_grid = rasters.on_grid(pixels.withColumnRenamed("flood_id", "raster_id"))
    return download.download(found, on_grid, region, a.to, force=a.force)


def _mirror(spark, a):
    wanted = tables.read_inventory(spark, a.inventory).select("filename", "size_bytes", F.lit(None).cast("string").alias("sha256"))
    return inventory.mirror_plan(wanted, mirror.listing(spark, a.target)) if a.dry_run else mirror.mirror(spark, wanted, a.source, a.target, a.ledger)


def _hazard_manifest(spark, a):
    made = hazard.manifest(tables.read_tiles(spark, a.tiles), a.base_url, a.model_version)
    bundle.write_json(spark, made, a.to)
    return spark.createDataFrame([(k, str(v)) for k, v in made.items()], "key string, value string")


def _hazard(spark, a):
    return hazard.catalogue(tables.read_tiles(spark, a.tiles), _region(spark, a), a.return_period)


def _seal(spark, a):
    files = bundle.seal(spark, a.index)["files"]
    return spark.createDataFrame([(k, v["size_bytes"], v["sha256"]) for k, v in files.items()], "name string, size_bytes long, sha256 string")


def _check(spark, a):
    bundle.validate_publication(spark, a.index, verify_checksums=True)
    return spark.createDataFrame([("valid",)], "manifest string")


def _verify(spark, a):
    ledger = spark.read.schema("filename string, size_bytes long, sha256 string").json(a.ledger)
    return inventory.verify(tables.read_inventory(spark, a.inventory), tables.file_records(spark, a.files), ledger, a.deep)


def _nuts(spark, a):
    return regions.search(tables.read_regions(spark, a.table), a.query, a.level, a.country)


def _doctor(spark, a):
    return bundle.doctor(*bundle.open_index(spark, a.index))


def _build(spark, a):
    records = tables.read_inventory(spark, a.inventory) if a.inventory else None
    made = bundle.build(tables.read_lake(spark, a.lake), a.index, records and records.drop("size_bytes"))
    return spark.createDataFrame([(k, str(v)) for k, v in made.items()], "key string, value string")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--out", help="write the result here (csv, json or parquet by its ending)")
    sub = p.add_subparsers(required=True)

    def command(name, f, region=False):
        c = sub.add_parser(name)
        c.set_defaults(run=f)
        if region:
            c.add_argument("--bbox", type=float, nargs=4)
            c.add_argument("--point", type=float, nargs=2)
            c.add_argument("--radius", type=float)
            c.add_argument("--buffer", type=float, default=0.0)
            c.add_argument("--region", help="a place's name")
            c.add_argument("--nuts", nargs="+", help="codes of statistical regions")
            c.add_argument("--vector-file", help="GeoJSON polygons")
            c.add_argument("--boundaries", help="GeoJSON that names and codes are looked up in")
            c.add_argument("--level", type=int)
            c.add_argument("--crs", type=int)
            c.add_argument("--shape", default="exact")
        return c

    c = command("floods", _floods, True)
    for name in ("--year", "--start", "--end"):
        c.add_argument(name)
    c.add_argument("--index", required=True)
    command("footprints", _footprints, True).add_argument("--index", required=True)
    c = command("recurrence", _recurrence, True)
    c.add_argument("--index", required=True)
    c.add_argument("--event", type=int)
    command("seal", _seal).add_argument("--index", required=True)
    command("check", _check).add_argument("--index", required=True)
    c = command("verify", _verify)
    c.add_argument("--inventory", required=True)
    c.add_argument("--files", required=True)
    c.add_argument("--ledger", required=True, help="JSON lines of filename, size_bytes and sha256")
    c.add_argument("--deep", action="store_true", help="compare checksums too")
    c = command("hazard", _hazard, True)
    c.add_argument("--tiles", required=True)
    c.add_argument("--return-period", type=int)
    command("polygons", _polygons, True).add_argument("--index", required=True)
    c = command("ingest", _ingest)
    for name in ("--rasters", "--inventory", "--lake", "--ledger"):
        c.add_argument(name, required=True)
    c.add_argument("--year", type=int)
    c.add_argument("--limit", type=int)
    c.add_argument("--max-depth", type=float)
    c = command("download", _download, True)
    for name in ("--index", "--rasters", "--inventory", "--to"):
        c.add_argument(name, required=True)
    for name in ("--year", "--start", "--end"):
        c.add_argument(name)
    c.add_argument("--force", action="store_true")
    c = command("mirror", _mirror)
    for name in ("--inventory", "--source", "--target", "--ledger"):
        c.add_argument(name, required=True)
    c.add_argument("--dry-run", action="store_true", help="only say what would be copied")
    c = command("hazard-manifest", _hazard_manifest)
    for name in ("--tiles", "--base-url", "--to"):
        c.add_argument(name, required=True)
    c.add_argument("--model-version", default="v1")
    c = command("nuts", _nuts)
    c.add_argument("query", nargs="?")
    c.add_argument("--table", required=True)
    c.add_argument("--level", type=int)
    c.add_argument("--country")
    command("doctor", _doctor).add_argument("--index", required=True)
    c = command("build-index", _build)
    c.add_argument("--lake", required=True)
    c.add_argument("--index", required=True)
    c.add_argument("--inventory")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    try:
        found = a.run(spark, a)
        if a.out:
            tables.write_catalogue(found, a.out)
        else:
            found.show(SHOWN, truncate=False)  # the first rows; --out writes all
            if (n := found.count()) > SHOWN:
                print(f"and {n - SHOWN} more")
        return 0
    except tuple(k for k, _ in CODES) as e:
        print(e, file=sys.stderr)
        return next(code for kind, code in CODES if isinstance(e, kind))


if __name__ == "__main__":
    sys.exit(main())
