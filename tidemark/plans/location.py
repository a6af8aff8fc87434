"""From what a user names (a place, codes, a vector file, a box, a point) to one region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.projections import CRSError
from tidemark.operators import regions, roi
from tidemark.sources import tables

#: A region is a constant of the plan, on the driver: beyond so many corners its shapes are overlaid as a table (operators/shapes).
CORNERS = 200_000


def region_of(features: DataFrame, crs: int = 4326) -> roi.Roi:
    """The union of features (rings); an error if there are none, or more corners than a constant should have."""
    drawn = features.where("rings IS NOT NULL AND size(rings) > 0").select("rings")
    n = drawn.agg(F.sum(F.aggregate("rings", F.lit(0).cast("long"), lambda a, r: a + F.size(r)))).first()[0]
    if not n:
        raise roi.RoiError("no polygon was found for the region")
    if n > CORNERS:
        raise roi.RoiError(f"the region has {n} corners; overlay it as a table, or take its hull or envelope")
    parts = [[[(p.x, p.y) for p in ring] for ring in row.rings] for row in drawn.collect()]  # at most CORNERS points
    return roi.union([roi.from_rings(rings, crs) for rings in sorted(parts)])


def locate(
    spark: SparkSession, *, region: str | None = None, nuts: str | Sequence[str] | None = None, vector_file: str | None = None, point=None, bbox=None,
    radius_m: float | None = None, level: int | None = None, boundaries: DataFrame | None = None, buffer_m: float = 0.0, crs: int | None = None, shape: str = "exact",
) -> roi.Roi:
    """The region of exactly one of region (a name), nuts (codes), vector_file (GeoJSON), point and bbox.

    boundaries (NUTS_ID, LEVL_CODE, NAME_LATN, NUTS_NAME, rings) are those that names and codes are looked up in.
    """
    if sum(x is not None for x in (region, nuts, vector_file, point, bbox)) != 1:
        raise roi.RoiError("give exactly one of region, nuts, vector_file, point and bbox")
    if point is not None or bbox is not None:
        return roi.resolve(point=point, radius_m=radius_m, bbox=bbox, buffer_m=buffer_m, crs=crs or 4326, shape=shape)
    if vector_file is not None:
        found = region_of(tables.read_features(spark, vector_file, "name:string"), crs or 4326)
    else:
        if crs is not None:
            raise CRSError("names and codes are looked up in degrees; crs does not apply to them")
        if boundaries is None:
            raise roi.RoiError("names and codes need a table of boundaries")
        found = region_of(regions.by_code(boundaries, nuts) if nuts is not None else regions.geocode(boundaries, region, level))
    found = found.shaped(shape)
    return found.buffered(buffer_m) if buffer_m else found
