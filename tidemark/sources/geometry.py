"""Polygons as well-known binary, the form that files of geometry hold, on Arrow batches."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: little-endian, and the codes of its shapes.
_LITTLE, _POINT, _POLYGON, _MULTI = 1, 1, 3, 6
RINGS = "array<array<struct<x:double,y:double>>>"
POLYGONS = f"array<{RINGS}>"


def _rings(rings) -> bytes:
    out = [struct.pack("<BII", _LITTLE, _POLYGON, len(rings))]
    for ring in rings:
        closed = list(ring) if len(ring) and (ring[0]["x"], ring[0]["y"]) == (ring[-1]["x"], ring[-1]["y"]) else [*ring, *ring[:1]]
        out.append(struct.pack("<I", len(closed)) + b"".join(struct.pack("<2d", p["x"], p["y"]) for p in closed))
    return b"".join(out)


def _read(data: bytes, at: int, kinds: tuple[int, ...]) -> tuple[int, int, str, int]:
    order = "<" if data[at] == _LITTLE else ">"
    kind, n = struct.unpack_from(order + "II", data, at + 1)
    if kind not in kinds:
        raise ValueError(f"geometry of kind {kind} is not read here")
    return kind, n, order, at + 9


def _polygon(data: bytes, at: int) -> tuple[list, int]:
    _, n, order, at = _read(data, at, (_POLYGON,))
    rings = []
    for _ in range(n):
        size = struct.unpack_from(order + "I", data, at)[0]
        flat = struct.unpack_from(f"{order}{2 * size}d", data, at + 4)
        rings.append([{"x": x, "y": y} for x, y in zip(flat[::2], flat[1::2], strict=True)])
        at += 4 + 16 * size
    return rings, at


def _one(rings: pa.Array) -> pa.Array:
    return pa.array([None if r is None else _rings(r) for r in rings.to_pylist()], pa.binary())


def _many(polygons: pa.Array) -> pa.Array:
    whole = lambda ps: struct.pack("<BII", _LITTLE, _MULTI, len(ps)) + b"".join(map(_rings, ps))
    return pa.array([None if ps is None else whole(ps) for ps in polygons.to_pylist()], pa.binary())


def _back(data: pa.Array) -> pa.Array:
    def polygons(raw):
        if raw is None:
            return None
        kind, n, _, at = _read(raw, 0, (_POLYGON, _MULTI))
        if kind == _POLYGON:
            return [_polygon(raw, 0)[0]]
        out = []
        for _ in range(n):
            rings, at = _polygon(raw, at)
            out.append(rings)
        return out

    kind = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
    return pa.array([polygons(x) for x in data.to_pylist()], kind)


def wkb(geometry: Column, several: bool = False) -> Column:
    """Rings (the outer one first; closed if they are not), or with `several` a list of such, as binary. Null stays null."""
    return F.arrow_udf(_many if several else _one, "binary")(geometry)


def polygons(data: Column) -> Column:
    """Binary of polygons and multipolygons, of either byte order, as a list of polygons of rings."""
    return F.arrow_udf(_back, POLYGONS)(data)


def bounds(rings: Column) -> Column:
    """(xmin, ymin, xmax, ymax) of rings, as a struct that readers prune by."""
    x, y = F.transform(F.flatten(rings), lambda p: p["x"]), F.transform(F.flatten(rings), lambda p: p["y"])
    return F.struct(F.array_min(x).alias("xmin"), F.array_min(y).alias("ymin"), F.array_max(x).alias("xmax"), F.array_max(y).alias("ymax"))


def write_geoparquet(catalogue: DataFrame, path: str) -> None:
    """catalogue with its geometry (or polygons) as well-known binary and its bounds, in Parquet, and beside the data files
    `_geo.json`, what the geometry column holds, in degrees.

    Spark's writer has no place for it in the footers themselves; a reader that asks for it there takes the columns by name.
    """
    import json

    several = "polygons" in catalogue.columns
    shape = F.col("polygons" if several else "geometry")
    flat = F.flatten(shape) if several else shape
    out = catalogue.withColumns({"wkb": wkb(shape, several), "bbox": bounds(flat)}).drop("polygons", "geometry").withColumnRenamed("wkb", "geometry")
    out.write.mode("overwrite").parquet(path)
    told = {"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": ["MultiPolygon" if several else "Polygon"], "covering": {"bbox": {k: ["bbox", k] for k in ("xmin", "ymin", "xmax", "ymax")}}}}}
    spark = catalogue.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_geo.json")
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    stream.write(bytearray(json.dumps(told).encode()))
    stream.close()


def read_geoparquet(spark, path: str) -> DataFrame:
    """What write_geoparquet wrote, with the polygons as lists."""
    rows = spark.read.parquet(path)
    return rows.withColumn("polygons", polygons(F.col("geometry"))).drop("geometry", "bbox")
