"""The published index: building it in one go, its manifest, and its checks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import grid
from tidemark.operators import lake as ops
from tidemark.plans.scratch import lasting, release
from tidemark.sources import tables

FINGERPRINT = {"origin_x": grid.ORIGIN_X, "origin_y": grid.ORIGIN_Y, "resolution": grid.RESOLUTION, "width_px": grid.WIDTH, "height_px": grid.HEIGHT}
BYTES_PER_CELL = 12


class IndexMissingError(FileNotFoundError):
    """There is no index at the path."""


class ManifestError(ValueError):
    """The manifest is absent, or its versions or grid are not those of this engine."""


def export_plan(lake: DataFrame) -> DataFrame:
    """Cells to be written and an estimate of their bytes, in one row."""
    return ops.populated_cells(lake).withColumn("estimated_bytes", F.col("populated_cells") * BYTES_PER_CELL)


def build(lake: DataFrame, path: str, inventory: DataFrame | None = None) -> dict:
    """Writes index, dictionary and events, and the manifest last: a path without a manifest is not an index."""
    spark = lake.sparkSession
    cells = lasting(ops.build_cells(lake))
    combos = lasting(ops.number_combos(cells))
    tables.write_index(ops.build_pixel_combo(cells, combos), path)
    tables.write_dictionary(combos, path)
    tables.write_events(ops.build_events(combos, inventory), path)
    release(cells, combos)
    manifest = {
        "cache_schema_version": tables.CACHE_SCHEMA_VERSION, "dictionary_schema_version": tables.DICTIONARY_SCHEMA_VERSION, "grid": FINGERPRINT,
        "n_combos": tables.read_dictionary(spark, path).count(), "n_cells": tables.read_index(spark, path).count(),
    }
    write_json(spark, manifest, f"{path}/manifest")
    return manifest


def write_json(spark: SparkSession, record: dict, path: str) -> None:
    """Through Spark's writer, so that the path may be in any store."""
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    try:
        return json.loads("".join(r.value for r in spark.read.text(path).collect()))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise ManifestError(f"no manifest at {path}") from None


def validate_manifest(manifest: dict) -> None:
    for key, want in (("cache_schema_version", tables.CACHE_SCHEMA_VERSION), ("dictionary_schema_version", tables.DICTIONARY_SCHEMA_VERSION)):
        if manifest.get(key) != want:
            raise ManifestError(f"{key} is {manifest.get(key)}, not {want}")
    there = manifest.get("grid", {})
    if any(abs(there.get(k, float("nan")) - v) > 1e-12 or k not in there for k, v in FINGERPRINT.items()):
        raise ManifestError("the index is on another grid")


def restamp(spark: SparkSession, path: str, source_urls: dict[str, str]) -> dict:
    """Adds source addresses to the manifest, beside those it has."""
    manifest = read_json(spark, f"{path}/manifest")
    manifest["source_urls"] = manifest.get("source_urls", {}) | source_urls
    write_json(spark, manifest, f"{path}/manifest")
    return manifest


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """What a publication lists: name, size and checksum of each data file."""
    return tables.file_records(spark, path).where(~F.col("filename").startswith("_"))


def seal(spark: SparkSession, path: str) -> dict:
    """Puts size and checksum of each data file, by its path within the index, into the manifest."""
    manifest = read_json(spark, f"{path}/manifest")
    manifest["files"] = {r.name: {"size_bytes": r.size_bytes, "sha256": r.sha256} for r in _sealed(spark, path).toLocalIterator()}
    write_json(spark, manifest, f"{path}/manifest")
    return manifest


def _sealed(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    within = F.element_at(F.split("path", f"/{path.rstrip('/').rsplit('/', 1)[-1]}/", 2), 2)
    return files.select(within.alias("name"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def validate_publication(spark: SparkSession, path: str, verify_checksums: bool = False) -> None:
    """An error unless the manifest fits this engine and, if asked, each listed file is there with its checksum."""
    manifest = read_json(spark, f"{path}/manifest")
    validate_manifest(manifest)
    if "files" not in manifest:
        raise ManifestError("the manifest lists no files")
    if verify_checksums:
        listed = spark.createDataFrame([(k, v["sha256"]) for k, v in manifest["files"].items()], "name string, want string")
        odd = listed.join(_sealed(spark, path), "name", "left").where("sha256 IS NULL OR sha256 <> want")
        if bad := odd.select("name", F.col("sha256").isNull().alias("absent")).orderBy("name").first():
            raise ManifestError(f"{bad.name} {'is missing' if bad.absent else 'has another checksum'}")


def open_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """pixel_combo, dictionary and events of a checked index."""
    validate_manifest(read_json(spark, f"{path}/manifest"))
    return tables.read_index(spark, path), tables.read_dictionary(spark, path), tables.read_events(spark, path)


def locate(local: str | None, remote: str | None, mode: str = "auto", offline: bool = False) -> str:
    """Which root to read: the local one, the remote one, or the first of them that is given."""
    root = {"auto": local or (None if offline else remote), "local": local, "remote": None if offline else remote}[mode]
    if root is None:
        raise IndexMissingError(f"no index for mode {mode!r}")
    return root


def doctor(pixel_combo: DataFrame, combos: DataFrame, events: DataFrame) -> DataFrame:
    """One row per check (check, ok, found): ids dense and resolvable, cells on the grid and single, events known."""
    dense = combos.agg(F.min("combo_id").alias("a"), F.max("combo_id").alias("b"), F.count_distinct("combo_id").alias("n"))
    dense = dense.select(F.lit("combo_ids_dense").alias("check"), ((F.col("a") == 1) & (F.col("b") == F.col("n"))).alias("ok"), F.col("n").alias("found"))
    none = lambda rows, name: rows.agg(F.count(F.lit(1)).alias("found")).select(F.lit(name).alias("check"), (F.col("found") == 0).alias("ok"), "found")
    ids = combos.select(F.explode("flood_ids").alias("global_id")).distinct()
    unsorted = combos.where(F.col("flood_ids") != F.array_sort(F.array_distinct("flood_ids")))
    return (
        dense.unionByName(none(pixel_combo.join(combos, "combo_id", "left_anti"), "unknown_combos"))
        .unionByName(none(pixel_combo.where(~grid.is_valid(F.col("col"), F.col("row"))), "cells_off_grid"))
        .unionByName(none(pixel_combo.groupBy("col", "row").count().where("count > 1"), "cells_twice"))
        .unionByName(none(ids.join(events, "global_id", "left_anti"), "unknown_events"))
        .unionByName(none(unsorted, "lists_unsorted"))
    )
