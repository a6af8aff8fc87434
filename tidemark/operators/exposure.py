"""What lies in the floods: overlays by region, segments and places near events, exceedance curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import grid


def area_by_region(cells: DataFrame, regions: DataFrame, on: str = "row") -> DataFrame:
    """Cells and exact area of each region; regions (region, key): each cell belongs to those with its key."""
    counted = cells.groupBy(on, "row").agg(F.count(F.lit(1)).alias("cells")) if on != "row" else cells.groupBy("row").agg(F.count(F.lit(1)).alias("cells"))
    joined = counted.join(regions, on)
    return joined.groupBy("region").agg(F.sum("cells").alias("cells"), F.round(F.sum(F.col("cells") * grid.equal_area_km2(F.col("row"))), 6).alias("area_km2"))


def overlay(cells: DataFrame, shapes: DataFrame) -> DataFrame:
    """cells with the shapes (shape, min_col, max_col, min_row, max_row) that hold them, met in tiles and then compared."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / grid.TILE).cast("int"), F.floor(F.col(b) / grid.TILE).cast("int")))
    tiled = shapes.withColumn("tile_col", span("min_col", "max_col")).withColumn("tile_row", span("min_row", "max_row"))
    at = cells.withColumn("tile_col", grid.tile_col(F.col("col"))).withColumn("tile_row", grid.tile_row(F.col("row")))
    inside = "col BETWEEN min_col AND max_col AND row BETWEEN min_row AND max_row"
    return at.join(tiled, ["tile_col", "tile_row"]).where(inside).select(*cells.columns, "shape")


def near_count(places: DataFrame, cells: DataFrame, metres: float) -> DataFrame:
    """Distinct events within a distance of each place (place, lon, lat); cells have flood_id.

    Both sides are dealt into squares at least as wide as the distance, in bands of latitude each with its own width; a
    place looks into its own and the eight around.
    """
    size_lat = metres / 110_000
    at = cells.withColumn("x", grid.center_lon(F.col("col"))).withColumn("y", grid.center_lat(F.col("row")))
    far = F.least(F.greatest(F.abs(F.col("sy") - 1), F.abs(F.col("sy") + 2)) * F.lit(size_lat), F.lit(90.0))  # places that look into the band
    size_lon = F.when(F.cos(F.radians(far)) > size_lat / 720, F.lit(size_lat) / F.cos(F.radians(far))).otherwise(720.0)
    band = lambda y: F.floor(F.col(y) / F.lit(size_lat)).cast("long")
    square = lambda x: F.floor(F.col(x) / size_lon).cast("long")
    at = at.withColumn("sy", band("y")).withColumn("sx", square("x"))
    around = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))
    mine = places.withColumn("sy", band("lat")).withColumn("sy", around("sy"))
    mine = mine.withColumn("sx", square("lon")).withColumn("sx", around("sx"))
    dx = (F.col("x") - F.col("lon")) * F.lit(grid.METRES_PER_DEGREE) * F.cos(F.radians("lat"))
    dy = (F.col("y") - F.col("lat")) * F.lit(grid.METRES_PER_DEGREE)
    close = mine.join(at, ["sx", "sy"]).where(dx * dx + dy * dy <= float(metres) ** 2)
    counted = close.select("place", "flood_id").distinct().groupBy("place").agg(F.count(F.lit(1)).alias("n_events"))
    return places.select("place").join(counted, "place", "left").select("place", F.coalesce("n_events", F.lit(0)).alias("n_events"))


def segment_counts(segments: DataFrame, cells: DataFrame) -> DataFrame:
    """Distinct events that touch each segment (segment, length_km, and its box of cells)."""
    boxes = segments.withColumnRenamed("segment", "shape")
    hit = overlay(cells, boxes).select("shape", "flood_id").distinct().groupBy("shape").agg(F.count(F.lit(1)).alias("n_events"))
    return boxes.join(hit, "shape", "left").select(F.col("shape").alias("segment"), "length_km", F.coalesce("n_events", F.lit(0)).alias("n_events"))


def exceedance(counts: DataFrame, weight: str = "length_km") -> DataFrame:
    """For every number of events t, the total weight of what has t or more. Rows are reduced to one per number first."""
    by_n = counts.where("n_events > 0").groupBy("n_events").agg(F.sum(weight).alias("w"))
    above = Window.orderBy(F.desc("n_events")).rowsBetween(Window.unboundedPreceding, 0)  # one row per number of events
    return by_n.select(F.col("n_events").alias("threshold"), F.round(F.sum("w").over(above), 6).alias("total"))
