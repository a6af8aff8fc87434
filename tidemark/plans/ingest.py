"""Incremental ingest: which records are due, their cells, and the ledger lines that result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import inventory as ops
from tidemark.operators import lake


def plan(inventory: DataFrame, ledger: DataFrame, **filters) -> DataFrame:
    """The records that a run would process."""
    return ops.pending(ops.candidates(inventory, **filters), ops.latest(ledger))


def run(due: DataFrame, pixels: DataFrame, max_depth: float | None = None, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells with the year of their event, ledger lines) for the due records; pixels are (lon, lat, value, flood_id).

    A record without pixels is a failed download; one with pixels but no cell is empty. Where pixel tables leave dry pixels
    out, files (flood_id, has_crs) tells which rasters could be read.
    """
    mine = pixels.join(due.select(F.col("global_id").alias("flood_id")), "flood_id", "left_semi")
    cells = lake.pixels_to_lake(mine, max_depth=max_depth)
    points = cells.groupBy("flood_id").agg(F.count(F.lit(1)).alias("points"))
    there = mine.select("flood_id", F.lit(True).alias("has_crs")) if files is None else files.select("flood_id", "has_crs")
    seen = there.groupBy("flood_id").agg(F.bool_or("has_crs").alias("has_crs")).withColumn("seen", F.lit(True))
    joined = due.join(seen, F.col("global_id") == F.col("flood_id"), "left").drop("flood_id").join(points, F.col("global_id") == F.col("flood_id"), "left")
    download = F.when(F.col("seen"), "ok").otherwise("failed")
    process = F.when(F.col("points") > 0, "complete").when(F.col("seen") & ~F.col("has_crs"), "missing_crs").when(F.col("seen"), "empty")
    lines = joined.select("global_id", "filename", download.alias("download_status"), process.alias("process_status"), F.coalesce("points", F.lit(0)).alias("points"))
    years = due.select(F.col("global_id").alias("flood_id"), "year")
    return cells.join(years, "flood_id").select("col", "row", "flood_id", "year"), lines


def dead_letters(ledger: DataFrame) -> DataFrame:
    return ops.latest(ledger).where((F.col("download_status") == "failed") | F.col("process_status").isin("failed", "missing_crs"))
