"""Discovery: which events flooded a region, when, and over what area; and the catalogue's own operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import grid
from tidemark.functions.text import norm_end, norm_start
from tidemark.operators.roi import Roi

COLUMNS = ["collection", "event_id", "date", "year", "end_date", "cluster_id", "filename", "download_url", "area_km2"]


def combo_counts(index: DataFrame, roi: Roi) -> DataFrame:
    """Pixels per combo inside the region."""
    return roi.mask(index).groupBy("combo_id").agg(F.count(F.lit(1)).alias("pixels"))


def combo_listing(counts: DataFrame) -> DataFrame:
    """combo_counts in the order of their combos, as a report shows them; joins take them as they are."""
    return counts.orderBy("combo_id")


def event_pixels(counts: DataFrame, combos: DataFrame) -> DataFrame:
    """Pixels per event: combos are counted before they are expanded. Combos that the dictionary lacks are dropped."""
    expanded = counts.join(combos, "combo_id").select("pixels", F.explode("flood_ids").alias("event_id"))
    return expanded.groupBy("event_id").agg(F.sum("pixels").alias("pixels"))


def floods(
    index: DataFrame, combos: DataFrame, events: DataFrame, roi: Roi, year: int | str | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """One row per event in the region. Time filters look at the start date alone, as text; they prune the events first.

    Events without metadata are dropped. The area takes one cell area for all, that at the region's centroid.
    """
    events = period(events, year, start, end)
    area = grid.flat_cell_area_km2(roi.measured(index.sparkSession)[1])
    found = event_pixels(combo_counts(index, roi), combos).join(events, F.col("event_id") == F.col("global_id"))
    return found.select(
        F.lit("historic").alias("collection"), "event_id", F.col("start_date").alias("date"), "year", "end_date", "cluster_id", "filename", "download_url",
        F.round(F.col("pixels") * area, 3).alias("area_km2"),
    )


def period(events: DataFrame, year=None, start: str | None = None, end: str | None = None, date: str = "start_date") -> DataFrame:
    if year is not None:
        events = events.where(F.col("year") == str(year))
    if start is not None:
        events = events.where(F.col(date) >= norm_start(str(start)))
    return events.where(F.col(date) <= norm_end(str(end))) if end is not None else events


def legacy_events(dictionary: DataFrame, events: DataFrame) -> DataFrame:
    """Events embedded in a legacy dictionary, for all rows, when there are any; else the table."""
    inner = dictionary.select(F.explode("events").alias("e")).select("e.*").dropDuplicates(["global_id"])
    return events if inner.isEmpty() else inner


def summary(catalogue: DataFrame) -> DataFrame:
    """Count, span of dates and total area, in one row."""
    return catalogue.agg(
        F.count(F.lit(1)).alias("events"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.round(F.sum("area_km2"), 3).alias("total_km2")
    )


def largest(catalogue: DataFrame, k: int, by: str = "area_km2") -> DataFrame:
    return catalogue.orderBy(F.desc(by), "event_id").limit(k)


def per_year(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy("year").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("area_km2"), 3).alias("area_km2"))


def is_hazard(catalogue: DataFrame) -> bool:
    return "return_period" in catalogue.columns


def crop_name(date: Column, event_id: Column, key: str) -> Column:
    return F.format_string(f"flood_%s_id%d_{key}.tif", date, event_id)


def attach_paths(catalogue: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """catalogue with the path of each event's crop, null where there is none (files: filename, path)."""
    named = catalogue.withColumn("crop", crop_name(F.col("date"), F.col("event_id"), key))
    return named.join(files.select(F.col("filename").alias("crop"), "path"), "crop", "left").drop("crop")


def has_path(catalogue: DataFrame) -> DataFrame:
    """Rows whose crop is there: a path that is not null, not empty and no "nan"."""
    path = F.trim(F.col("path").cast("string"))
    return catalogue.where(path.isNotNull() & (path != "") & (F.lower(path) != "nan"))


def median_by(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The exact median of a value in each group."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("events"), F.round(F.median(value), 6).alias(f"median_{value}"))


def downloadable(catalogue: DataFrame) -> DataFrame:
    return catalogue.where(F.col("download_url").isNotNull() & F.col("filename").isNotNull())


def first_seen(catalogue: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    rows = catalogue.groupBy(key).agg(F.min_by(F.struct("*"), order).alias("r"))
    return rows.select("r.*")
