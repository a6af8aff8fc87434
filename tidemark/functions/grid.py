"""The global cell grid as Column expressions: 3 arc-seconds in EPSG:4326, rows counted southwards."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the grid and of the WGS 84 ellipsoid.
ORIGIN_X, ORIGIN_Y = -46.8, 85.1
RESOLUTION = 1 / 1200
WIDTH, HEIGHT = round(109.8 * 1200), round(58.1 * 1200)
METRES_PER_DEGREE = 111_320.0
SEMI_MAJOR, ECC2 = 6_378_137.0, 0.00669437999014
TILE = 512
MAX_ID = 2**32 - 1


def _index(steps: Column, valid: Column) -> Column:
    # floor(NaN) is 0, which is a cell: what is not finite is told apart before it is cast.
    whole = F.floor(F.when(valid, steps).otherwise(F.lit(-1.0)))
    return F.when(F.abs(whole) < 2**31, whole).otherwise(-1).cast("int")


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def cell_col(lon: Column, lat: Column | None = None) -> Column:
    """The cell's column for a longitude; -1 where a coordinate is null, NaN or infinite."""
    valid = _finite(lon) if lat is None else _finite(lon) & _finite(lat)
    return _index((lon - F.lit(ORIGIN_X)) / F.lit(RESOLUTION), valid)


def cell_row(lat: Column, lon: Column | None = None) -> Column:
    valid = _finite(lat) if lon is None else _finite(lon) & _finite(lat)
    return _index((F.lit(ORIGIN_Y) - lat) / F.lit(RESOLUTION), valid)


def is_valid(col: Column, row: Column) -> Column:
    """Upper bounds are exclusive."""
    return (col >= 0) & (col < WIDTH) & (row >= 0) & (row < HEIGHT)


def center_lon(col: Column) -> Column:
    return F.lit(ORIGIN_X) + (col + F.lit(0.5)) * F.lit(RESOLUTION)


def center_lat(row: Column) -> Column:
    return F.lit(ORIGIN_Y) - (row + F.lit(0.5)) * F.lit(RESOLUTION)


def pack_cell(col: Column, row: Column) -> Column:
    return F.shiftleft(col.cast("long"), 32).bitwiseOR(row.cast("long"))


def unpack_col(cell: Column) -> Column:
    return F.shiftright(cell, 32).cast("int")


def unpack_row(cell: Column) -> Column:
    return cell.bitwiseAND(F.lit(2**32 - 1)).cast("int")


def tile_col(col: Column) -> Column:
    return F.floor(col / TILE).cast("int")


def tile_row(row: Column) -> Column:
    return F.floor(row / TILE).cast("int")


def flat_cell_area_km2(lat: Column | float) -> Column:
    """The area that one query takes for all its cells: that of a cell at the latitude of the region's centroid."""
    side = RESOLUTION * METRES_PER_DEGREE
    return F.lit(side) * F.cos(F.radians(lat if isinstance(lat, Column) else F.lit(lat))) * F.lit(side) / F.lit(1e6)


def authalic_q(lat: Column) -> Column:
    """The q of the ellipsoidal equal-area projection for a latitude in degrees."""
    e, s = math.sqrt(ECC2), F.sin(F.radians(lat))
    return F.lit(1 - ECC2) * (s / (F.lit(1.0) - F.lit(ECC2) * s * s) - F.log((F.lit(1.0) - F.lit(e) * s) / (F.lit(1.0) + F.lit(e) * s)) / F.lit(2 * e))


def equal_area_km2(row: Column) -> Column:
    """The exact area of a cell of this row on the ellipsoid."""
    north = F.lit(ORIGIN_Y) - row * F.lit(RESOLUTION)
    south = F.lit(ORIGIN_Y) - (row + F.lit(1)) * F.lit(RESOLUTION)
    return F.lit(SEMI_MAJOR**2 * math.radians(RESOLUTION) / 2 / 1e6) * (authalic_q(north) - authalic_q(south))
