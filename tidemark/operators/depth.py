"""Depth rasters as pixel tables (raster_id, col, row, value): crops, statistics, composites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.roi import Roi

#: Metres in a raster's unit.
HISTORIC_SCALE, HAZARD_SCALE = 0.01, 1.0


#: More rasters than this are shown only when a limit is asked for.
SHOWN_RASTERS = 4


class DepthError(ValueError):
    """More rasters than are shown unasked."""


def guarded(catalogue: DataFrame, limit: int | None = None) -> DataFrame:
    """The rows whose depths are to be fetched: all, if they are few, or the first by date; an error for many without a limit."""
    if limit is None and catalogue.limit(SHOWN_RASTERS + 1).count() > SHOWN_RASTERS:
        raise DepthError(f"more than {SHOWN_RASTERS} rasters; give limit=")
    return catalogue if limit is None else catalogue.orderBy("date", "event_id").limit(limit)


def depth_scale(collection: Column) -> Column:
    return F.when(collection == "hazard", HAZARD_SCALE).otherwise(HISTORIC_SCALE)


def catalogue_stats(catalogue: DataFrame, pixels: DataFrame, pixel_area_m2: float, scale: float | None = None, **how) -> DataFrame:
    """stats of the pixels of a catalogue's rasters (raster_id: the event or the return period), in its collection's unit unless told."""
    from tidemark.operators.catalog import is_hazard

    key = "return_period" if is_hazard(catalogue) else "event_id"
    mine = pixels.join(catalogue.select(F.col(key).alias("raster_id")).distinct(), "raster_id", "left_semi")
    return stats(mine, pixel_area_m2, (HAZARD_SCALE if is_hazard(catalogue) else HISTORIC_SCALE) if scale is None else scale, **how)


def mask_nodata(value: Column, nodata: Column | None = None) -> Column:
    """Null for NaN, infinite, zero, -9999 and the declared nodata."""
    odd = F.isnan(value) | (F.abs(value) == float("inf")) | (value == 0) | (value == -9999)
    return F.when(~(odd if nodata is None else odd | F.coalesce(value == nodata, F.lit(False))), value)


def crop(pixels: DataFrame, roi: Roi) -> DataFrame:
    """Pixels inside the region; a raster of which nothing is left has no rows."""
    return roi.mask(pixels)


def stats(pixels: DataFrame, pixel_area_m2: float, scale: float = HISTORIC_SCALE, nodata: float | None = None, max_depth: float | None = None, by: list[str] | None = None) -> DataFrame:
    """Wet pixels, largest, mean and 95th percentile depth, area and volume of each raster; zeros where all is dry."""
    by = ["raster_id"] if by is None else by
    keep = (F.col("value") > 0) & (F.col("value") != F.lit(0.0 if nodata is None else nodata))
    if max_depth is not None:
        keep = keep & (F.col("value") <= max_depth)
    depth = F.when(keep, F.col("value") * scale)
    found = pixels.groupBy(*by).agg(
        F.count(depth).alias("n_pixels"),
        F.coalesce(F.max(depth), F.lit(0.0)).alias("max_depth_m"),
        F.coalesce(F.avg(depth), F.lit(0.0)).alias("mean_depth_m"),
        F.coalesce(F.percentile(depth, F.lit(0.95)), F.lit(0.0)).alias("p95_depth_m"),
        F.coalesce(F.sum(depth), F.lit(0.0)).alias("total"),
    )
    volume = F.col("total") * pixel_area_m2
    return found.select(
        *by, "n_pixels", F.round("max_depth_m", 4).alias("max_depth_m"), F.round("mean_depth_m", 4).alias("mean_depth_m"), F.round("p95_depth_m", 4).alias("p95_depth_m"),
        F.round(F.col("n_pixels") * pixel_area_m2 / 1e6, 4).alias("area_km2"), F.round(volume, 1).alias("volume_m3"), F.round(volume / 1e6, 4).alias("volume_mm3"),
    )


def composite(pixels: DataFrame, how: str = "max", order: str = "raster_id") -> DataFrame:
    """One value per cell over all rasters: max, min, first or last by the order column."""
    value = {"max": F.max("value"), "min": F.min("value"), "first": F.min_by("value", order), "last": F.max_by("value", order)}[how]
    return pixels.where("value > 0").groupBy("col", "row").agg(value.alias("value"))


def summary(pixels: DataFrame, pixel_area_m2: float, scale: float = HISTORIC_SCALE) -> DataFrame:
    """Statistics of the deepest value of each cell, overlaps counted once, with the number of rasters."""
    whole = stats(composite(pixels), pixel_area_m2, scale, by=[])
    return whole.crossJoin(F.broadcast(pixels.agg(F.count_distinct("raster_id").alias("n_events"))))  # one row each


def histogram(pixels: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    bucket = F.width_bucket("value", F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return pixels.where((F.col("value") >= low) & (F.col("value") < high)).groupBy(bucket.alias("bin")).agg(F.count(F.lit(1)).alias("pixels"))


def reproject_nearest(pixels: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (col, row, x, y: place in the source's pixel units) with the value of the pixel that holds each place."""
    source = pixels.select(F.col("col").alias("c"), F.col("row").alias("r"), "value")
    at = targets.withColumn("c", F.floor("x").cast("int")).withColumn("r", F.floor("y").cast("int"))
    return at.join(source, ["c", "r"]).select("col", "row", "value")


def reproject_bilinear(pixels: DataFrame, targets: DataFrame) -> DataFrame:
    """The mean of the four nearest pixel centres that have a value, by distance along both axes."""
    x, y = F.col("x") - 0.5, F.col("y") - 0.5
    corners = F.explode(F.array(*[F.struct((F.floor(x) + i).cast("int").alias("c"), (F.floor(y) + j).cast("int").alias("r")) for i in (0, 1) for j in (0, 1)]))
    at = targets.select("col", "row", x.alias("x"), y.alias("y"), corners.alias("k")).select("col", "row", "x", "y", "k.*")
    weight = (1 - F.abs(F.col("x") - F.col("c"))) * (1 - F.abs(F.col("y") - F.col("r")))
    source = pixels.select(F.col("col").alias("c"), F.col("row").alias("r"), "value")
    near = at.join(source, ["c", "r"]).withColumn("w", weight)
    mean = F.sum(F.col("w") * F.col("value")) / F.sum("w")
    return near.groupBy("col", "row").agg(F.when(F.sum("w") > 0, mean).alias("value")).where("value IS NOT NULL")


def exact_quantiles(rows: DataFrame, by: list[str], value: str, share: float, bins: int = 64, gathered: int = 20_000) -> DataFrame:
    """(by, n, quantile): the interpolated quantile of each group, as `percentile` gives it, without holding a group's distinct values.

    The two order statistics around the rank are looked for in a histogram of a group's candidates, whose bounds are approximate
    percentiles, each a range of its own; exact counts tell the range that holds the rank, and a round keeps its candidates, about
    one in `bins`, until a group has few enough, or one value alone, to sort. Sketches and counts have partial results, so that a
    group of any size costs a few scans. NaN and null take no part.
    """
    from tidemark.plans.scratch import lasting, release

    keys = [F.col(c) for c in by]
    real = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.col(value).cast("double").alias("v"))
    group = [f"k{i}" for i in range(len(keys))] or ["k"]
    real = real if by else real.withColumn("k", F.lit(0))
    total = real.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    at = (F.col("n") - 1) * F.lit(float(share))
    wanted = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor(at).alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil(at).alias("rank")))).alias("w")
    goals = lasting(total.select(*group, "n", wanted).select(*group, "n", "w.side", F.col("w.rank").cast("long").alias("rank")))
    seek, found, frame = [*group, "side"], [], real
    # rank counts from the least candidate; low and high bound the candidates.
    bounds = real.groupBy(*group).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    state = lasting(goals.join(bounds, group).withColumn("left", F.col("n")))
    while True:
        few = lasting(state.where((F.col("left") <= gathered) | (F.col("low") == F.col("high"))))
        inside = frame.join(few.where("low < high"), group).where("v >= low AND v <= high")
        sorted_ = inside.groupBy(*seek).agg(F.sort_array(F.collect_list("v")).alias("vs"), F.first("rank").alias("rank"))
        found.append(lasting(few.where("low = high").select(*seek, F.col("low").alias("q")).unionByName(sorted_.select(*seek, F.get("vs", F.col("rank").cast("int")).alias("q")))))
        more = state.join(few.select(*seek), seek, "left_anti")
        if more.isEmpty():
            break
        held = frame.join(more, group).where("v >= low AND v <= high")
        edges = held.groupBy(*seek).agg(F.percentile_approx("v", [k / bins for k in range(bins + 1)], 100 * bins).alias("edges"))
        held = held.join(F.broadcast(lasting(edges)) if not by else edges, seek)
        held = held.withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("v"))) * 2 + F.array_contains("edges", F.col("v")).cast("int"))
        counted = lasting(held.groupBy(*seek, "bin").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"), F.first("rank").alias("rank"), F.first("n").alias("n")))
        order = Window.partitionBy(*seek).orderBy("bin")  # some rows for each of bins
        placed = counted.withColumn("before", F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        right = placed.where("rank >= before AND rank < before + c")
        after = lasting(right.select(*group, "n", "side", (F.col("rank") - F.col("before")).alias("rank"), F.col("least").alias("low"), F.col("most").alias("high"), F.col("c").alias("left")))
        release(state, counted)
        state = after
    values = found[0]
    for x in found[1:]:
        values = values.unionByName(x)
    both = values.groupBy(*group).agg(F.max(F.when(F.col("side") == 0, F.col("q"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("q"))).alias("b"))
    part = at - F.floor(at)
    out = total.join(both, group).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(by)], "n", (F.col("a") * (1 - part) + F.col("b") * part).alias("quantile"))
    return out
