"""Crops and composites of a catalogue's rasters, written as Parquet beside their provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import catalog, depth, hazard
from tidemark.operators.roi import Roi


def historic(catalogue: DataFrame, pixels: DataFrame, roi: Roi) -> DataFrame:
    """The valid pixels (raster_id, col, row, value) of the catalogue's events inside the region, with the crop's name and source.

    An event of which the region holds no valid pixel has no rows, and so no crop.
    """
    wanted = catalog.downloadable(catalogue).select(
        F.col("event_id").alias("raster_id"), catalog.crop_name(F.col("date"), F.col("event_id"), roi.key).alias("crop"), F.col("filename").alias("source"), "download_url"
    )
    return depth.crop(pixels, roi).where(depth.mask_nodata(F.col("value")).isNotNull()).join(wanted, "raster_id")


def modelled(catalogue: DataFrame, pixels: DataFrame, needed: DataFrame, present: DataFrame, roi: Roi) -> DataFrame:
    """The mosaics of the catalogue's return periods whose tiles are all there, with the crop's name."""
    asked = catalogue.select("return_period", F.col("filename").alias("crop"))
    return hazard.gated_mosaic(pixels, needed, present, roi).join(F.broadcast(asked), "return_period")  # at most one row per return period


def download(catalogue: DataFrame, pixels: DataFrame, roi: Roi, path: str, needed: DataFrame | None = None, present: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Writes the crops of a catalogue, one folder each, and gives it back with their paths (null where there is none).

    The collection tells the way: `hazard` has return periods, all else are events. Crops that are there stay unless forced;
    those that are written again replace only themselves.
    """
    modelled_ones = catalog.is_hazard(catalogue)
    if modelled_ones and (needed is None or present is None):
        raise hazard.HazardError("mosaics need the tables of needed and present tiles")
    spark = catalogue.sparkSession
    crops = modelled(catalogue, pixels, needed, present, roi) if modelled_ones else historic(catalogue, pixels, roi)
    if force:
        crops.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("crop").parquet(path)
    else:
        crops.join(_written(spark, path), "crop", "left_anti").write.mode("append").partitionBy("crop").parquet(path)
    name = F.col("filename") if modelled_ones else catalog.crop_name(F.col("date"), F.col("event_id"), roi.key)
    there = _written(spark, path).withColumn("path", F.concat(F.lit(f"{path}/crop="), "crop"))
    return catalogue.withColumn("crop", name).join(there, "crop", "left").drop("crop")


def _written(spark, path: str) -> DataFrame:
    """The names of the crops under a path, from the partitions' names alone."""
    try:
        return spark.read.parquet(path).select("crop").distinct()
    except Exception as e:
        if not any(k in str(e) for k in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "UNRESOLVED_COLUMN")):  # absent, or without any crop
            raise
        return spark.createDataFrame([], "crop string")


def write_composite(pixels: DataFrame, path: str, how: str = "max") -> None:
    """One value per cell over all rasters, by tile rows."""
    from tidemark.functions.grid import tile_row

    depth.composite(pixels, how).withColumn("tile_row", tile_row(F.col("row"))).write.mode("overwrite").partitionBy("tile_row").parquet(path)
