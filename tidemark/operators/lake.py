"""From raster pixels to the cell lake, and from the lake to the inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import grid
from tidemark.plans.scratch import lasting


def wet(value: Column, nodata: Column | float | None = None, max_depth: float | None = None) -> Column:
    """A pixel above zero that is not the declared nodata value, and no deeper than is plausible."""
    holds = (value > 0) & ~F.isnan(value)
    if nodata is not None:
        nodata = nodata if isinstance(nodata, Column) else F.lit(nodata)
        holds = holds & (nodata.isNull() | (value != nodata))
    return holds & (value <= max_depth) if max_depth is not None else holds


def pixels_to_lake(pixels: DataFrame, nodata: float | None = None, max_depth: float | None = None, on_grid: bool = True) -> DataFrame:
    """Rows (lon, lat, value, flood_id) as the distinct valid cells of each event; ids outside of 32 bits are an error.

    on_grid: whether cells beyond the grid's edges are left out; what has no place at all always is.
    """
    checked = F.when((F.col("flood_id") < 0) | (F.col("flood_id") > grid.MAX_ID), F.raise_error(F.lit("flood_id outside of 32 bits"))).otherwise(F.col("flood_id"))
    cells = pixels.where(wet(F.col("value"), nodata, max_depth)).select(
        grid.cell_col(F.col("lon"), F.col("lat")).alias("col"), grid.cell_row(F.col("lat"), F.col("lon")).alias("row"), checked.cast("long").alias("flood_id")
    )
    return cells.where(_counts(on_grid)).distinct()


def _counts(on_grid: bool) -> Column:
    """Whether a cell counts: of the grid, or, where its edges do not matter, any but that of no place."""
    return grid.is_valid(F.col("col"), F.col("row")) if on_grid else (F.col("col") != -1) & (F.col("row") != -1)


def process_status(pixels: DataFrame, has_crs: bool = True, on_grid: bool = True) -> DataFrame:
    """One row (flood_id, status, points) per event of a pixel table (col, row, value, flood_id); on_grid as for pixels_to_lake."""
    wet_cell = F.when(wet(F.col("value")) & _counts(on_grid), F.struct("col", "row"))
    counted = pixels.groupBy("flood_id").agg(F.count_distinct(wet_cell).alias("points"))
    status = F.lit("missing_crs") if not has_crs else F.when(F.col("points") > 0, "complete").otherwise("empty")
    return counted.select("flood_id", status.alias("status"), F.col("points"))


def outcomes(asked: DataFrame, pixels: DataFrame, cached: DataFrame | None = None, on_grid: bool = True) -> DataFrame:
    """One row (flood_id, status, points) per asked raster (flood_id, has_crs), whatever became of it.

    complete: cells from this run; cached: cells from an earlier one (flood_id, points); empty: read, but nothing wet;
    missing_file: no pixels at all; missing_crs: cannot be placed. Only complete and cached have points. on_grid as for pixels_to_lake.
    """
    read = process_status(pixels, on_grid=on_grid).select("flood_id", F.col("status").alias("found"), F.col("points").alias("n"))
    rows = asked.join(read, "flood_id", "left")
    before = F.lit(None).cast("long")
    if cached is not None:
        rows, before = rows.join(cached.select("flood_id", F.col("points").alias("before")), "flood_id", "left"), F.col("before")
    status = F.when(before.isNotNull(), "cached").when(F.col("found").isNull(), "missing_file").when(~F.coalesce("has_crs", F.lit(False)), "missing_crs").otherwise(F.col("found"))
    told = rows.select("flood_id", status.alias("status"), "n", before.alias("b"))
    return told.select("flood_id", "status", F.when(F.col("status") == "cached", F.col("b")).when(F.col("status") == "complete", F.col("n")).otherwise(0).alias("points"))


def build_cells(lake: DataFrame) -> DataFrame:
    """Every cell with the sorted distinct list of its events; partial aggregates run before the shuffle."""
    return lake.groupBy("col", "row").agg(F.array_sort(F.collect_set("flood_id")).alias("flood_ids"))


def number_combos(cells: DataFrame) -> DataFrame:
    """The distinct lists, numbered densely from 1 in their order, without gathering them in one task.

    Lists are range-partitioned and sorted, and written with their places so that these stay; each row's number is
    its place in its partition plus the sizes of the partitions before.
    """
    ranged = cells.select("flood_ids").distinct().repartitionByRange("flood_ids").sortWithinPartitions("flood_ids")
    place = F.monotonically_increasing_id()
    placed = lasting(ranged.select("flood_ids", F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("place")))
    sizes = placed.groupBy("part").count().orderBy("part").collect()  # a number per partition
    before, total = [], 0
    for r in sizes:
        before.append((r["part"], total))
        total += r["count"]
    offsets = cells.sparkSession.createDataFrame(before, "part long, before long")
    return placed.join(F.broadcast(offsets), "part").select((F.col("place") + F.col("before") + 1).alias("combo_id"), "flood_ids")


def build_pixel_combo(cells: DataFrame, combos: DataFrame) -> DataFrame:
    """Each cell's combo, joined on a hash of the list and on the list."""
    keyed = combos.select("combo_id", F.col("flood_ids").alias("ids"), F.xxhash64("flood_ids").alias("h"))
    return cells.withColumn("h", F.xxhash64("flood_ids")).join(keyed, ["h"]).where("flood_ids = ids").select("col", "row", "combo_id")


def build_events(combos: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """One row per event that some combo holds; without an inventory the ids alone."""
    ids = combos.select(F.explode("flood_ids").alias("global_id")).distinct()
    return ids if inventory is None else inventory.join(ids, "global_id", "left_semi")


def populated_cells(lake: DataFrame) -> DataFrame:
    return lake.select("col", "row").distinct().agg(F.count(F.lit(1)).alias("populated_cells"))


def dictionary_lookup(combos: DataFrame, ids: DataFrame) -> DataFrame:
    """Combos by id; unknown ids are dropped."""
    return combos.join(ids.select("combo_id").distinct(), "combo_id", "left_semi")


def events_lookup(events: DataFrame, ids: DataFrame) -> DataFrame:
    return events.join(ids.select("global_id").distinct(), "global_id", "left_semi")
