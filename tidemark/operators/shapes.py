"""Shapes as tables: polygons and lines of any number against cells, and cells back into polygons.

Polygons become intervals of longitude per row of the grid, so the overlay is a join on (row, tile) with a comparison behind
it: no test of every cell against every edge, and no geometry is gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import grid
from tidemark.functions.projections import transverse, untransverse
from tidemark.plans.scratch import dealt, lasting


#: Degrees between corners before a distance is laid around a line, sides of a quarter circle, and how far, in distances, a sharp corner goes.
DENSE, QUADRANT, MITRE = 0.02, 16, 5.0


def edges(shapes: DataFrame, *kept: str) -> DataFrame:
    """The sides (shape, kept, x0, y0, x1, y1) of shapes (shape, rings: arrays of (x, y)), rings closed. Null and empty rings have none."""
    ring = shapes.select("shape", *kept, F.explode("rings").alias("ring")).where("size(ring) > 0")
    ends = F.arrays_zip(F.col("ring").alias("p"), F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1)).alias("q"))
    side = ring.select("shape", *kept, F.explode(ends).alias("e"))
    return side.select("shape", *kept, F.col("e.p.x").alias("x0"), F.col("e.p.y").alias("y0"), F.col("e.q.x").alias("x1"), F.col("e.q.y").alias("y1"))


def _rows_between(south: Column, north: Column) -> Column:
    """The rows of the grid that a band of latitudes can meet, or no array where it lies outside of the grid."""
    row = lambda y: F.floor((F.lit(grid.ORIGIN_Y) - y) / F.lit(grid.RESOLUTION)).cast("int")
    first, last = F.greatest(row(north) - 1, F.lit(0)), F.least(row(south) + 1, F.lit(grid.HEIGHT - 1))
    return F.when(first <= last, F.sequence(first, last))


def spans(shapes: DataFrame) -> DataFrame:
    """Intervals (shape, row, west, east) that each shape holds at the centres of a row, by the even-odd rule.

    A centre is inside where west <= lon < east. A group is one row of one shape: as large as the sides that cross it.
    """
    side = edges(shapes).where("y0 <> y1")
    at = side.withColumn("row", F.explode(_rows_between(F.least("y0", "y1"), F.greatest("y0", "y1"))))
    lat = grid.center_lat(F.col("row"))
    met = at.where((F.col("y0") > lat) != (F.col("y1") > lat))
    x = (F.col("x1") - F.col("x0")) * (lat - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0")
    crossed = met.groupBy("shape", "row").agg(F.sort_array(F.collect_list(x)).alias("x"))
    pair = F.explode(F.sequence(F.lit(0), F.floor(F.size("x") / 2).cast("int") - 1))
    return crossed.withColumn("k", pair).select("shape", "row", F.get("x", F.col("k") * 2).alias("west"), F.get("x", F.col("k") * 2 + 1).alias("east"))


def union_spans(spans: DataFrame) -> DataFrame:
    """Intervals (shape, row, west, east) of each shape with those that overlap made one."""
    row = Window.partitionBy("shape", "row").orderBy("west", "east")
    opened = spans.withColumn("reach", F.max("east").over(row.rowsBetween(Window.unboundedPreceding, -1)))
    opened = opened.withColumn("new", (F.col("reach").isNull() | (F.col("west") > F.col("reach"))).cast("int"))
    grouped = opened.withColumn("g", F.sum("new").over(row.rowsBetween(Window.unboundedPreceding, 0))).groupBy("shape", "row", "g")
    return grouped.agg(F.min("west").alias("west"), F.max("east").alias("east")).drop("g")


def middle(rings: Column) -> Column:
    """The middle meridian of the UTM zone around the middle of a shape's longitudes."""
    x = F.transform(F.flatten(rings), lambda p: p["x"])
    return F.floor(((F.array_min(x) + F.array_max(x)) / 2 + 180) / 6) * 6.0 - 177.0


def _dense(shapes: DataFrame, meridian: Column | None = None) -> DataFrame:
    """Sides (shape, ring, k, middle, turn, px, py, qx, qy) in metres, of at most DENSE degrees each; turn is positive for a ring that runs counterclockwise."""
    cross = lambda ring: F.aggregate(F.sequence(F.lit(1), F.size(ring)), F.lit(0.0), lambda a, i: a + _cross(ring, i))
    ringed = shapes.where("size(rings) > 0").select("shape", (middle(F.col("rings")) if meridian is None else meridian).alias("middle"), F.posexplode("rings").alias("ring", "at")).where("size(at) > 0")
    single = ringed.select("shape", "middle", "ring", cross(F.col("at")).alias("turn"), F.posexplode("at").alias("k", "p"), "at")
    nxt = F.get("at", (F.col("k") + 1) % F.size("at"))
    side = single.select("shape", "middle", "ring", "turn", "k", F.col("p.x").alias("x0"), F.col("p.y").alias("y0"), nxt["x"].alias("x1"), nxt["y"].alias("y1"))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    parts = F.greatest(F.ceil(F.sqrt(dx * dx + dy * dy) / DENSE), F.lit(1)).cast("int")
    cut = side.withColumn("n", parts).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda i: (F.col("x0") + dx * i / F.col("n"), F.col("y0") + dy * i / F.col("n"))
    (ax, ay), (bx, by) = at(F.col("i")), at(F.col("i") + 1)
    cut = cut.select("shape", "middle", "ring", "turn", "k", "i", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))
    (px, py), (qx, qy) = (transverse(F.col(x), F.col(y), F.col("middle")) for x, y in (("ax", "ay"), ("bx", "by")))
    flat = cut.select("shape", "middle", "ring", "turn", "k", "i", px.alias("px"), py.alias("py"), qx.alias("qx"), qy.alias("qy"))
    return flat.where("px <> qx OR py <> qy")


def _cross(ring: Column, i: Column) -> Column:
    p, q = F.get(ring, i - 1), F.get(ring, i % F.size(ring))
    return p["x"] * q["y"] - q["x"] * p["y"]


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


_PIECE = ["shape", "ring", "k", "i"]


def _round(side: DataFrame, metres: float) -> DataFrame:
    """Each side with a half circle at both ends, as one convex ring in metres."""
    way = F.atan2(F.col("qy") - F.col("py"), F.col("qx") - F.col("px"))
    step = F.lit(math.pi / 2 / QUADRANT)
    half = lambda x, y, start: F.transform(F.sequence(F.lit(0), F.lit(2 * QUADRANT)), lambda i: _point(F.col(x) + metres * F.cos(way + start + i * step), F.col(y) + metres * F.sin(way + start + i * step)))
    return side.select(*_PIECE, F.lit(0).alias("kind"), "middle", F.concat(half("qx", "qy", -math.pi / 2), half("px", "py", math.pi / 2)).alias("piece"))


def _mitred(side: DataFrame, metres: float) -> DataFrame:
    """Each side as a strip to its outside, and at each corner that turns outwards the wedge between two strips up to where their far
    sides meet; a wedge longer than MITRE distances is cut off. Rings are to be simple, as boxes and hulls are."""
    long = F.sqrt((F.col("qx") - F.col("px")) ** 2 + (F.col("qy") - F.col("py")) ** 2)
    out = F.signum("turn")
    side = side.withColumns({"nx": (F.col("qy") - F.col("py")) / long * out * metres, "ny": -(F.col("qx") - F.col("px")) / long * out * metres})
    ring = Window.partitionBy("shape", "ring").orderBy("k", "i")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(whole))
    side = side.withColumns({"mx": near("nx"), "my": near("ny")})
    p, q, n, m = (tuple(F.col(c + v) for v in "xy") for c in "pqnm")
    add = lambda a, b, by=F.lit(1.0): (a[0] + b[0] * by, a[1] + b[1] * by)
    strip = F.array(*[_point(*v) for v in (p, q, add(q, n), add(p, n))])
    same = (n[0] * m[0] + n[1] * m[1]) / metres**2
    turns = (n[0] * m[1] - n[1] * m[0]) * out > 0
    far = F.sqrt(F.lit(2.0) / F.greatest(F.lit(1.0) + same, F.lit(1e-12)))  # of the tip, in distances
    both = add(n, m)
    tip = add(q, both, F.least(far, F.lit(MITRE)) / far / F.greatest(F.lit(1.0) + same, F.lit(1e-12)))
    wedge = F.when(turns, F.array(*[_point(*v) for v in (q, add(q, n), tip, add(q, m))]))
    return side.select(*_PIECE, "middle", F.posexplode(F.array_compact(F.array(strip, wedge))).alias("kind", "piece"))


def buffered_spans(shapes: DataFrame, metres: float, mitre: bool = False, meridian: Column | None = None) -> DataFrame:
    """Disjoint intervals (shape, row, west, east) of what lies in each shape or within a distance of it.

    The distance is laid around each side, in metres of the transverse Mercator projection around the middle of the shape's
    UTM zone (or the given one), as a convex piece; what the pieces and the shape hold of a row is united. No outline is built, so sides
    of any number may cross as they like, and nothing of a shape is gathered but one row of it.
    """
    side = _dense(shapes, meridian)
    if not mitre:
        side = side.repartition(*_PIECE)  # one shape may have most of the sides
    pieces = (_mitred if mitre else _round)(side, float(metres) / 0.9996)  # a UTM metre is 1 / 0.9996 of an unscaled one
    key = [*_PIECE, "kind"]
    drawn = pieces.select(*key, F.transform("piece", lambda p: _point(*untransverse(p["x"], p["y"], F.col("middle")))).alias("p"))
    ends = F.explode(F.arrays_zip("p", F.concat(F.slice("p", 2, F.size("p")), F.slice("p", 1, 1)).alias("q"))).alias("e")
    line = drawn.select(*key, ends).select(*key, "e.p.x", "e.p.y", F.col("e.q.x").alias("x1"), F.col("e.q.y").alias("y1"))
    at = line.where("y <> y1").withColumn("row", F.explode(_rows_between(F.least("y", "y1"), F.greatest("y", "y1"))))
    lat = grid.center_lat(F.col("row"))
    at = at.where((F.col("y") > lat) != (F.col("y1") > lat)).select(*key, "row", ((F.col("x1") - F.col("x")) * (lat - F.col("y")) / (F.col("y1") - F.col("y")) + F.col("x")).alias("x"))
    met = at.groupBy(*key, "row").agg(F.min("x").alias("west"), F.max("x").alias("east")).select("shape", "row", "west", "east")
    return union_spans(met.unionByName(spans(shapes)))


def _tile(lon: Column) -> Column:
    return F.floor((lon - F.lit(grid.ORIGIN_X)) / F.lit(grid.RESOLUTION * grid.TILE)).cast("int")


def cells_in_spans(cells: DataFrame, spans: DataFrame) -> DataFrame:
    """cells (col, row, ...) with the shape of each interval that holds their centres."""
    first, last = F.greatest(_tile(F.col("west")), F.lit(0)), F.least(_tile(F.col("east")), F.lit(grid.WIDTH // grid.TILE))
    tiled = spans.where((F.col("west") < F.col("east")) & (first <= last)).withColumn("tile_at", F.explode(F.sequence(first, last)))
    lon = grid.center_lon(F.col("col"))
    at = cells.withColumn("tile_at", _tile(lon))
    return at.join(tiled, ["row", "tile_at"]).where((lon >= F.col("west")) & (lon < F.col("east"))).select(*cells.columns, "shape")


def cells_within(cells: DataFrame, shapes: DataFrame) -> DataFrame:
    """cells (col, row, ...) with the shapes that hold their centres; a cell in several shapes occurs with each."""
    return cells_in_spans(cells, spans(shapes))


def area_within(cells: DataFrame, shapes: DataFrame) -> DataFrame:
    """Cells and exact area that lie in each shape. Equal (shape, row) are counted before areas are taken."""
    counted = cells_within(cells.select("col", "row"), shapes).groupBy("shape", "row").agg(F.count(F.lit(1)).alias("n"))
    area = F.round(F.sum(F.col("n") * grid.equal_area_km2(F.col("row"))), 6)
    return counted.groupBy("shape").agg(F.sum("n").alias("cells"), area.alias("area_km2"))


def union_cells(cells: DataFrame, shapes: DataFrame) -> DataFrame:
    """Those of the cells that any of the shapes holds, each once: the union of the shapes, without building its outline."""
    key = cells_within(cells.select("col", "row"), shapes).select("col", "row").distinct()
    return cells.join(key, ["col", "row"], "left_semi")


def line_strips(lines: DataFrame) -> DataFrame:
    """The cells that each straight line (shape, x0, y0, x1, y1) passes, as strips (shape, row, first, last)."""
    at = lines.withColumn("row", F.explode(_rows_between(F.least("y0", "y1"), F.greatest("y0", "y1"))))
    north = F.lit(grid.ORIGIN_Y) - F.col("row") * F.lit(grid.RESOLUTION)
    south = F.lit(grid.ORIGIN_Y) - (F.col("row") + 1) * F.lit(grid.RESOLUTION)
    low, high = F.greatest(F.least("y0", "y1"), south), F.least(F.greatest("y0", "y1"), north)
    x = lambda y: F.when(F.col("y0") == F.col("y1"), F.col("x0")).otherwise(F.col("x0") + (y - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0")))
    a, b = x(low), F.when(F.col("y0") == F.col("y1"), F.col("x1")).otherwise(x(high))
    col = lambda x: F.floor((x - F.lit(grid.ORIGIN_X)) / F.lit(grid.RESOLUTION)).cast("int")
    return at.where(low <= high).select("shape", "row", col(F.least(a, b)).alias("first"), col(F.greatest(a, b)).alias("last"))


def line_counts(lines: DataFrame, cells: DataFrame) -> DataFrame:
    """Distinct events whose cells each line (shape, x0, y0, x1, y1, ...) passes, with the columns of lines; 0 where none does.

    A line is a strip for each row that it meets, of which the planner's estimate knows nothing: both sides are always shuffled.
    """
    strips = line_strips(lines.select("shape", "x0", "y0", "x1", "y1"))
    tiled = strips.withColumn("tile_col", F.explode(F.sequence(grid.tile_col(F.col("first")), grid.tile_col(F.col("last")))))
    at = cells.select("row", "col", "flood_id", grid.tile_col(F.col("col")).alias("tile_col"))
    hit = at.join(tiled.hint("merge"), ["row", "tile_col"]).where("col BETWEEN first AND last").select("shape", "flood_id").distinct()
    counted = hit.groupBy("shape").agg(F.count(F.lit(1)).alias("n_events"))
    return lines.join(counted, "shape", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))


def merged(strips: DataFrame, by: list[str]) -> DataFrame:
    """Strips (by, row, first, last) with those of a row that overlap or adjoin made one."""
    before = Window.partitionBy(*by, "row").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*by, "row").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, 0)
    opened = strips.withColumn("reach", F.max("last").over(before)).withColumn("new", (F.col("reach").isNull() | (F.col("first") > F.col("reach") + 1)).cast("int"))
    grouped = opened.withColumn("g", F.sum("new").over(so_far)).groupBy(*by, "row", "g")
    return grouped.agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("g")


def rectangles(strips: DataFrame, by: list[str]) -> DataFrame:
    """Strips (by, row, first, last) as the fewest rectangles of equal strips of neighbouring rows; together they are the polygon.

    Overlapping and adjoining strips of a row are one strip before.
    """
    return stacked(merged(strips, by), None, by)


def stacked(whole: DataFrame, rows: int | None, by: list[str]) -> DataFrame:
    """Disjoint strips (by, row, first, last) as rectangles of equal strips of neighbouring rows; rows: a bound on their number, where one is known."""
    whole = whole.select(*by, "row", F.col("first").alias("min_col"), F.col("last").alias("max_col"))
    if rows is not None:
        whole = dealt(whole, rows, *by, "min_col", "max_col")
    place = F.col("row") - F.row_number().over(Window.partitionBy(*by, "min_col", "max_col").orderBy("row"))
    return whole.withColumn("island", place).groupBy(*by, "min_col", "max_col", "island").agg(F.min("row").alias("min_row"), F.max("row").alias("max_row")).drop("island")


def outline() -> Column:
    """The ring of a rectangle of cells (min_col, max_col, min_row, max_row), as a geometry of one closed ring in degrees."""
    lon = lambda c: F.lit(grid.ORIGIN_X) + c * F.lit(grid.RESOLUTION)
    lat = lambda r: F.lit(grid.ORIGIN_Y) - r * F.lit(grid.RESOLUTION)
    west, east = lon(F.col("min_col")), lon(F.col("max_col") + 1)
    north, south = lat(F.col("min_row")), lat(F.col("max_row") + 1)
    corners = [(west, north), (west, south), (east, south), (east, north), (west, north)]
    return F.array(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners]))


def event_strips(index: DataFrame, combos: DataFrame) -> DataFrame:
    """The strips (event_id, row, first, last) of each event's cells. Runs of cells of one combo are expanded to events, not cells."""
    from tidemark.operators.recurrence import runs

    return runs(index).join(combos, "combo_id").select(F.explode(F.array_distinct("flood_ids")).alias("event_id"), "row", "first", "last")


def dealt_strips(index: DataFrame, combos: DataFrame) -> DataFrame:
    """event_strips, dealt by event and row into tasks of a bounded size; they are written, which tells how many there are."""
    strips = lasting(event_strips(index, combos))
    return dealt(strips, strips.count(), "event_id", "row")


def footprint_parts(index: DataFrame, combos: DataFrame) -> DataFrame:
    """Each event's footprint as rectangles (event_id, min_col, max_col, min_row, max_row), dissolved over its combos."""
    whole = lasting(merged(dealt_strips(index, combos), ["event_id"]))
    return stacked(whole, whole.count(), ["event_id"])


def region_parts(labelled_runs: DataFrame) -> DataFrame:
    """The polygon of each region of recurrence.labelled_runs, as rectangles (region, combo_id, ...). A run alone is its region's rectangle."""
    by, row = ["region", "combo_id"], F.col("row")
    several = rectangles(labelled_runs.where("NOT alone").select(*by, "row", "first", "last"), by)
    one = labelled_runs.where("alone").select(*by, F.col("first").alias("min_col"), F.col("last").alias("max_col"), row.alias("min_row"), row.alias("max_row"))
    return several.unionByName(one)
