"""Modelled hazard: which tiles a region needs for each return period, and their mosaic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.roi import Roi, RoiError, meets_box

#: Return periods in years.
RETURN_PERIODS = (10, 20, 50, 75, 100, 200, 500)


class HazardError(ValueError):
    """A return period that the model lacks, or nothing could be produced."""


def return_periods(asked: int | list[int] | None) -> list[int]:
    periods = list(RETURN_PERIODS) if asked is None else [asked] if isinstance(asked, int) else list(asked)
    if odd := [x for x in periods if x not in RETURN_PERIODS]:
        raise HazardError(f"no such return period: {odd}; there are {RETURN_PERIODS}")
    return periods


def tile_filename(period: Column, tile_id: Column, name: Column) -> Column:
    return F.format_string("ID%s_%s_RP%d_depth.tif", tile_id, name, period)


def touching(tiles: DataFrame, roi: Roi) -> DataFrame:
    """Tiles whose box meets the region; the tile table is small (some hundred rows), the region is a constant."""
    x0, y0, x1, y1 = roi.bounds
    if not (roi.rings or roi.point):
        raise RoiError("the region is empty")
    near = tiles.where((F.col("minx") <= x1) & (F.col("maxx") >= x0) & (F.col("miny") <= y1) & (F.col("maxy") >= y0))
    return near if roi._box() else near.where(meets_box(roi, *[F.col(c) for c in ("minx", "miny", "maxx", "maxy")]))


def needed_files(tiles: DataFrame, roi: Roi, periods: int | list[int] | None = None) -> DataFrame:
    """A row for each tile and return period, files once."""
    each = F.explode(F.array(*[F.lit(p) for p in return_periods(periods)]))
    rows = touching(tiles, roi).withColumn("return_period", each)
    return rows.withColumn("filename", tile_filename(F.col("return_period"), F.col("tile_id"), F.col("name"))).dropDuplicates(["filename"])


def catalogue(tiles: DataFrame, roi: Roi, periods: int | list[int] | None = None, model_version: str = "v1") -> DataFrame:
    """One row per return period with tiles; the area is the region's."""
    counted = needed_files(tiles, roi, periods).groupBy("return_period").agg(F.count(F.lit(1)).alias("n_tiles"))
    return counted.select(
        F.lit("hazard").alias("collection"), "return_period", F.lit(model_version).alias("model_version"), "n_tiles",
        F.format_string(f"hazard_RP%d_{roi.key}.tif", F.col("return_period")).alias("filename"), F.lit(round(roi.measured(tiles.sparkSession)[0], 3)).alias("area_km2"),
    )


def manifest(tiles: DataFrame, base_url: str, model_version: str = "v1", before: dict | None = None) -> dict:
    """What a publication of the hazard layer pins: the address, the version, the return periods and the rules of names.

    Records of mirrored tiles in the manifest before are kept.
    """
    made = {
        "collection": "hazard", "model_version": model_version,
        "provenance": {
            "hazard_base_url": base_url, "return_periods": list(RETURN_PERIODS), "n_tiles": tiles.count(),
            "tile_filename_template": "ID{id}_{name}_RP{rp}_depth.tif", "tile_url_template": base_url + "RP{rp}/{filename}",
        },
    }
    return made | {k: before[k] for k in ("mirror",) if before and k in before}


def tiles_bounds(tiles: DataFrame) -> DataFrame:
    return tiles.agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def gate(needed: DataFrame, present: DataFrame) -> DataFrame:
    """Return periods with all of their files there: a mosaic of some tiles would look like a dry region."""
    there = needed.join(present.select("filename").distinct().withColumn("there", F.lit(1)), "filename", "left")
    counted = there.groupBy("return_period").agg(F.count(F.lit(1)).alias("expected"), F.count("there").alias("available"))
    return counted.withColumn("complete", F.col("expected") == F.col("available"))


def mosaic(pixels: DataFrame, roi: Roi, nodata: float = -9999.0) -> DataFrame:
    """The first valid value of each cell in the order of its sources (return_period, source, col, row, value)."""
    valid = roi.mask(pixels).where((F.col("value") != nodata) & ~F.isnan("value"))
    return valid.groupBy("return_period", "col", "row").agg(F.min_by("value", "source").alias("value"))


def gated_mosaic(pixels: DataFrame, needed: DataFrame, present: DataFrame, roi: Roi) -> DataFrame:
    """The mosaics of the complete return periods; an error if there is none."""
    complete = gate(needed, present).where("complete").select("return_period")
    if complete.isEmpty():
        raise HazardError("no return period has all of its tiles")
    return mosaic(pixels.join(F.broadcast(complete), "return_period", "left_semi"), roi)
