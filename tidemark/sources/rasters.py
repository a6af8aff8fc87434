"""GeoTIFF files as pixel tables, a stripe or tile of a file being the unit of work, and pixel tables as GeoTIFF files.

Spark lists and reads the files, in any store. A file's directory gives its stripes; their bytes are dealt out, and each is decoded by
itself, so a task holds one compressed file or some decoded stripes. Pixels of no data, and by default of zero, are no rows. Blocks that a
file leaves out (a size of 0) are of no data, or of zeros where none is declared; written files leave out those without pixels.

Read are classic and big TIFF of both byte orders, in stripes and in tiles, the first band, of integers or floats, without compression
or with deflate, LZW or Zstandard, with either predictor. A file that is none is a row of `headers` with its error, and has no pixels;
so has one without a known coordinate system, which `lake.outcomes` tells apart (has_crs).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import grid
from tidemark.functions.projections import ARRAYS, PLAIN, SUPPORTED, positions, project
from tidemark.plans.scratch import dealt, lasting

HEADER = (
    "raster string, error string, width int, height int, dtype string, epsg int, nodata double, affine array<double>, "
    "block_width int, block_height int, compression int, predictor int, bands int, planar int, big_endian boolean"
)
PIXELS = "raster string, col int, row int, value double, x double, y double, lon double, lat double"

# Fixed values of the format: tags, sizes of its types and codes of compression and of keys.
_TAGS = {
    256: "width", 257: "height", 258: "bits", 259: "compression", 273: "offsets", 277: "bands", 278: "strip_rows", 279: "counts", 284: "planar", 317: "predictor",
    322: "tile_width", 323: "tile_height", 324: "tile_offsets", 325: "tile_counts", 339: "format", 33550: "scale", 33922: "tie", 34264: "matrix", 34735: "keys", 42113: "nodata",
}
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
_PLACES, _WHOLE = {"offsets", "counts", "tile_offsets", "tile_counts"}, {1, 3, 4, 16}
_NONE, _LZW, _DEFLATE, _OLD_DEFLATE, _ZSTD = 1, 5, 8, 32946, 50000
_RASTER_TYPE, _GEOGRAPHIC, _PROJECTED = 1025, 2048, 3072
#: Fixed values of written files: columns from which on a raster is in tiles and not in stripes, sides of a tile, the blocks of a file above which its tiles
#: are larger, rows of a batch of pixels, and blocks and bytes of a batch of blocks.
WIDE, SIDES, MOST_BLOCKS, BATCH, BATCH_BLOCKS, BATCH_BYTES = 2048, (256, 512, 1024, 2048, 4096), 1 << 22, 65_536, 1024, 1 << 23


class RasterError(ValueError):
    """The bytes are no raster that is read here."""


def directory(data: bytes) -> dict:
    """The tags of the first image, by name; the places and sizes of its blocks are arrays, as there may be millions."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8:
        raise RasterError("not a TIFF file")
    big = struct.unpack_from(order + "H", data, 2)[0] == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    out = {"order": order}
    try:
        n = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
        at += 8 if big else 2
        for k in range(n):
            place = at + k * (20 if big else 12)
            tag, kind, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), data, place)
            if tag in _TAGS and kind in _TYPES:
                size = struct.calcsize(_TYPES[kind]) * count
                value = place + (12 if big else 8)
                if size > (8 if big else 4):
                    value = struct.unpack_from(order + ("Q" if big else "I"), data, value)[0]
                if _TAGS[tag] in _PLACES:
                    if kind in _WHOLE:
                        out[_TAGS[tag]] = np.frombuffer(data, order + _TYPES[kind], count, value) if count else np.zeros(0, np.int64)
                    continue
                found = struct.unpack_from(f"{order}{count}{_TYPES[kind]}", data, value)
                out[_TAGS[tag]] = found[0] if kind == 2 else list(found)
    except (struct.error, ValueError) as e:
        raise RasterError(f"cut off: {e}") from None
    return out


def header(data: bytes) -> tuple[dict, np.ndarray]:
    """(what HEADER names but for raster and error, blocks as rows of column, row, offset, bytes) of a file. Blocks left out are not among them, if no data are declared."""
    d = directory(data)
    one = lambda name, default=None: d.get(name, [default])[0]
    width, height, bits = one("width"), one("height"), one("bits", 1)
    if not width or not height or bits not in (8, 16, 32, 64):
        raise RasterError("no image of whole bytes")
    kind = {1: "u", 2: "i", 3: "f"}.get(one("format", 1))
    if kind is None or (kind == "f" and bits < 32):
        raise RasterError("neither integers nor floats")
    tiled = "tile_offsets" in d
    bw, bh = (one("tile_width"), one("tile_height")) if tiled else (width, min(one("strip_rows", height), height))
    across, down = -(-width // bw), -(-height // bh)
    offsets, counts = (d.get("tile_offsets"), d.get("tile_counts")) if tiled else (d.get("offsets"), d.get("counts"))
    if offsets is None or counts is None or len(offsets) < across * down or len(counts) < across * down:
        raise RasterError("blocks are missing")
    keys = {d["keys"][k]: d["keys"][k + 3] for k in range(4, len(d.get("keys", [])) - 3, 4) if d["keys"][k + 1] == 0}
    epsg = keys.get(_PROJECTED) or keys.get(_GEOGRAPHIC)
    affine = None
    if "matrix" in d:
        m = d["matrix"]
        affine = [m[3], m[0], m[1], m[7], m[4], m[5]]
    elif "scale" in d and "tie" in d:
        (sx, sy), (i, j, _, x, y) = d["scale"][:2], d["tie"][:5]
        affine = [x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy]
    if affine and keys.get(_RASTER_TYPE) == 2:  # the numbers are those of the first pixel's centre
        affine[0], affine[3] = affine[0] - (affine[1] + affine[2]) / 2, affine[3] - (affine[4] + affine[5]) / 2
    try:
        nodata = float(d["nodata"].rstrip(b"\0 ")) if "nodata" in d else None
    except ValueError:
        nodata = None
    there = np.flatnonzero(counts[: across * down]) if nodata is not None else np.arange(across * down)
    at, size = offsets[there], counts[there]
    if len(there) and (int(at.max()) > len(data) or int(size.max()) > len(data) or (at.astype(np.int64) + size.astype(np.int64) > len(data)).any()):
        raise RasterError("cut off: a block ends behind the file")
    blocks = np.stack([there % across * bw, there // across * bh, at.astype(np.int64), size.astype(np.int64)], axis=1)
    told = {
        "width": width, "height": height, "dtype": f"{kind}{bits // 8}", "epsg": epsg if epsg and epsg < 32767 else None, "nodata": nodata, "affine": affine, "block_width": bw, "block_height": bh,
        "compression": one("compression", 1), "predictor": one("predictor", 1), "bands": one("bands", 1), "planar": one("planar", 1), "big_endian": d["order"] == ">",
    }
    return told, blocks


def block(data: bytes, h: dict, rows: int) -> np.ndarray:
    """The first band of one block, of `rows` rows. One without bytes is of zeros."""
    if not data:
        return np.zeros((rows, h["block_width"]), dtype=h["dtype"])
    kind = np.dtype(h["dtype"]).newbyteorder(">" if h["big_endian"] else "<")
    bands = h["bands"] if h["planar"] == 1 else 1
    size = rows * h["block_width"] * bands * kind.itemsize
    raw = _unpacked(data, h["compression"], size)
    if len(raw) < size:
        raise RasterError("a block is too short")
    shape = (rows, h["block_width"], bands)
    if h["predictor"] == 3:  # the bytes of a row's numbers, highest first, as differences
        planes = np.cumsum(np.frombuffer(raw, np.uint8, size).reshape(rows, -1), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, -1)
        out = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.dtype(h["dtype"]).newbyteorder(">")).reshape(shape)
    else:
        out = np.frombuffer(raw, kind, size // kind.itemsize).reshape(shape).astype(np.dtype(h["dtype"]), copy=False)
        if h["predictor"] == 2:
            out = np.cumsum(out, axis=1, dtype=out.dtype)
    return out[..., 0]


def _unpacked(data: bytes, compression: int, size: int) -> bytes:
    if compression == _NONE:
        return data
    if compression in (_DEFLATE, _OLD_DEFLATE):
        return zlib.decompress(data)
    if compression == _LZW:
        return _lzw(data)
    if compression == _ZSTD:
        try:
            return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)
        except OSError:  # of another size
            return pa.CompressedInputStream(pa.BufferReader(data), "zstd").read()
    raise RasterError(f"compression {compression} is not read here")


def _lzw(data: bytes) -> bytes:
    table, out, last, width, held, bits = [], [], b"", 9, 0, 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, last, width = [bytes([k]) for k in range(256)] + [b"", b""], b"", 9
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last, width = entry, 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(raster: the file's name, content) of the TIFF files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tif").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("raster"), "content")


def _fields(text: str) -> list[str]:
    return [x.split()[0] for x in text.split(", ")]


def _bytes(value: pa.BinaryScalar) -> memoryview:
    """A file's bytes where they are, or none of a null."""
    return memoryview(value.as_buffer() if value.is_valid else b"")


def headers(files: DataFrame) -> DataFrame:
    """One row per file (raster, content): its header, or why it has none."""
    names = _fields(HEADER)

    def run(batches):
        for batch in batches:
            out = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    out.append({"raster": name, "error": None} | header(_bytes(data))[0])
                except RasterError as e:
                    out.append({"raster": name, "error": str(e)})
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in out], t) for c, t in zip(names, _HEADER_TYPES, strict=True)], names)

    return files.select("raster", "content").mapInArrow(run, HEADER)


_HEADER_TYPES = [
    pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(),
]


def window(head: dict, within: tuple[float, float, float, float]) -> tuple[int, int, int, int] | None:
    """(first column, first row, last column, last row) of the pixels that bounds in degrees can meet, or None if there are none.

    The bounds' sides are followed in the raster's own system, as they are curves there. A raster that cannot be placed has all of its pixels.
    """
    a, width, height = head["affine"], head["width"], head["height"]
    if not a or head["epsg"] not in SUPPORTED or a[2] or a[4]:
        return 0, 0, width - 1, height - 1
    x0, y0, x1, y1 = within
    share = [k / 32 for k in range(33)]
    border = [(x0 + (x1 - x0) * t, y) for t in share for y in (y0, y1)] + [(x, y0 + (y1 - y0) * t) for t in share for x in (x0, x1)]
    flat = [project(lon, lat, head["epsg"], PLAIN) for lon, lat in border]
    cols, rows = [(x - a[0]) / a[1] for x, _ in flat], [(y - a[3]) / a[5] for _, y in flat]
    slack = [2 + (max(v) - min(v)) * 1e-3 for v in (cols, rows)]  # what a side bends between two of its points
    first = max(int(min(cols) - slack[0]), 0), max(int(min(rows) - slack[1]), 0)
    last = min(int(max(cols) + slack[0]), width - 1), min(int(max(rows) + slack[1]), height - 1)
    return (*first, *last) if first[0] <= last[0] and first[1] <= last[1] else None


def blocks(files: DataFrame, within: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(raster, band_col, band_row, data, head) of each block of the readable files, dealt out evenly; data are its bytes as they are in the file.

    within: bounds in degrees; blocks that they cannot meet are left out.
    """

    def run(batches):
        import json

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = _bytes(data)
                try:
                    head, found = header(content)
                except RasterError:
                    continue
                text = json.dumps(head)
                if within is not None:
                    seen = window(head, within)
                    c0, r0, c1, r1 = seen or (1, 1, 0, 0)
                    found = found[(found[:, 0] <= c1) & (found[:, 0] + head["block_width"] > c0) & (found[:, 1] <= r1) & (found[:, 1] + head["block_height"] > r0)]
                sized = np.cumsum(found[:, 3])
                k = 0
                while k < len(found):  # so many blocks, or so many bytes
                    end = int(np.searchsorted(sized, (sized[k - 1] if k else 0) + BATCH_BYTES, "right"))
                    some = found[k : max(min(k + BATCH_BLOCKS, end), k + 1)]
                    k += len(some)
                    parts = [bytes(content[o : o + n]) for _, _, o, n in some.tolist()]
                    columns = [pa.array([name] * len(some)), pa.array(some[:, 0], pa.int32()), pa.array(some[:, 1], pa.int32()), pa.array(parts, pa.binary()), pa.array([text] * len(some))]
                    yield pa.RecordBatch.from_arrays(columns, ["raster", "band_col", "band_row", "data", "head"])

    found = files.select("raster", "content").mapInArrow(run, "raster string, band_col int, band_row int, data binary, head string")
    return found.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "raster", "band_col", "band_row")  # so many, as their bytes say little of their pixels


def pixels(files: DataFrame, dry: bool = False, within: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The pixels of files (raster, content): place in the raster, value, the centre's place in the raster's system and in degrees.

    Pixels of the declared no-data value, of NaN and, unless `dry`, of zero are left out. Without a known system lon and lat are null,
    without a transformation x and y too. within: bounds in degrees, of which blocks are read and pixels kept; those that
    cannot be placed are then left out.
    """
    names = _fields(PIXELS)

    def run(batches):
        import json

        held, heads, n = {}, {}, 0
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH_BLOCKS):
                some = batch.slice(k, BATCH_BLOCKS)
                for name, col, row, data, text in zip(*(some.column(c).to_pylist() for c in range(5)), strict=True):
                    if text not in heads:
                        heads[text] = json.loads(text)
                    part = _decoded(col, row, data, heads[text], dry)
                    if len(part[0]):
                        held.setdefault(text, []).append((name, *part))
                        n += len(part[0])
                    if n >= BATCH or len(heads) > BATCH_BLOCKS:
                        for text, parts in held.items():
                            yield from _placed(parts, heads[text], names)
                        held, heads, n = {}, {}, 0
        for text, parts in held.items():
            yield from _placed(parts, heads[text], names)

    found = blocks(files, within).mapInArrow(run, PIXELS)
    if within is None:
        return found
    x0, y0, x1, y1 = within
    return found.where(F.col("lon").between(x0, x1) & F.col("lat").between(y0, y1))


def _decoded(col, row, data, h, dry) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, rows, columns) of a block's pixels."""
    rows = h["block_height"] if h["block_width"] != h["width"] or row + h["block_height"] <= h["height"] else h["height"] - row
    try:
        values = block(data, h, rows)
    except RasterError:  # a tile of the last row holds all its rows, a stripe only those that are left
        values = block(data, h, h["height"] - row)
    at = np.arange(values.size) if dry else _nonzero(values)
    value, r, c = values.reshape(-1)[at].astype(np.float64), at // values.shape[1] + row, at % values.shape[1] + col
    keep = ~np.isnan(value) & (r < h["height"]) & (c < h["width"])  # tiles reach beyond the edge
    if h["nodata"] is not None:
        keep &= value != h["nodata"]
    return (value, r, c) if keep.all() else (value[keep], r[keep], c[keep])


def _nonzero(values: np.ndarray) -> np.ndarray:
    """np.flatnonzero, eight values at a time, as most blocks are nearly empty."""
    there = (values != 0).reshape(-1)
    if there.size % 8:
        return np.flatnonzero(there)
    at = (np.flatnonzero(there.view(np.uint64))[:, None] * 8 + np.arange(8)).reshape(-1)
    return at[there[at]]


def _placed(parts, h, names) -> Iterator[pa.RecordBatch]:
    """Batches of the pixels of some blocks (raster, values, rows, columns) under one header."""
    value, r, c = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
    told = pa.DictionaryArray.from_arrays(np.repeat(np.arange(len(parts), dtype=np.int32), [len(p[1]) for p in parts]), pa.array([p[0] for p in parts], pa.string()))
    none = pa.nulls(len(r), pa.float64())
    x = y = lon = lat = none
    if h["affine"]:
        x0, xc, xr, y0, yc, yr = h["affine"]
        px, py = x0 + xc * (c + 0.5) + xr * (r + 0.5), y0 + yc * (c + 0.5) + yr * (r + 0.5)
        x, y = pa.array(px), pa.array(py)
        if h["epsg"] in SUPPORTED:
            lon, lat = map(pa.array, positions(px, py, h["epsg"], ARRAYS))
    columns = [told.dictionary_decode(), pa.array(c.astype(np.int32)), pa.array(r.astype(np.int32)), pa.array(value), x, y, lon, lat]
    for k in range(0, len(r), BATCH):
        yield pa.RecordBatch.from_arrays([v.slice(k, BATCH) for v in columns], names)


def statistics_area(header_row) -> float:
    """Square metres of a pixel of a raster in metres."""
    a = header_row["affine"]
    return abs(a[1] * a[5] - a[2] * a[4])


def lake_pixels(pixels: DataFrame, ids: DataFrame) -> DataFrame:
    """(lon, lat, value, flood_id) of placed pixels for lake.pixels_to_lake; ids (raster, flood_id) name the events."""
    return pixels.where("lon IS NOT NULL").join(ids, "raster").select("lon", "lat", "value", "flood_id")


def on_grid(pixels: DataFrame) -> DataFrame:
    """Placed pixels with the index's column and row in place of their own."""
    at = pixels.where("lon IS NOT NULL").withColumns({"col": grid.cell_col(F.col("lon"), F.col("lat")), "row": grid.cell_row(F.col("lat"), F.col("lon"))})
    return at.where(grid.is_valid(F.col("col"), F.col("row")))


def encode(rows: DataFrame, west: float, north: float, step: float, epsg: int = 4326, stripe: int = 64, nodata: float = 0.0) -> DataFrame:
    """(raster, content): a GeoTIFF of 32-bit floats for each raster of rows (raster, col, row, value), over the columns and rows that it has.

    Stripes of `stripe` rows, or tiles where a raster is wider than WIDE, are packed (Zstandard) one by one and then joined: a task holds one decoded
    block, and a file once its blocks are small, both filled as sorted rows come by; tasks are as many as the pixels and the files' directories ask for. Blocks without pixels are neither made nor stored, so the work
    grows with the pixels and not with the area around them. west and north are those of column 0 and row 0. Of several values of a pixel the largest stays.
    """
    span = rows.groupBy("raster").agg(F.min("col").alias("c0"), F.max("col").alias("c1"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.count(F.lit(1)).alias("n"))
    wide, high = F.col("c1") - F.col("c0") + 1, F.col("r1") - F.col("r0") + 1
    side = F.lit(SIDES[-1])
    for s in reversed(SIDES[:-1]):
        side = F.when(F.ceil(wide / s) * F.ceil(high / s) <= MOST_BLOCKS, s).otherwise(side)
    span = span.withColumns({"bw": F.when(wide > WIDE, side).otherwise(wide).cast("int"), "bh": F.when(wide > WIDE, side).otherwise(F.lit(stripe)).cast("int")})
    span = lasting(span)  # a row for each raster; the planner knows how few they are
    total = span.agg(F.sum("n").alias("pixels"), F.sum(F.ceil(wide / F.col("bw")) * F.ceil(high / F.col("bh"))).alias("blocks")).first()
    pixels, parts = total.pixels or 0, total.blocks or 0
    x, y, across = F.col("col") - F.col("c0"), F.col("row") - F.col("r0"), F.ceil(wide / F.col("bw"))
    down = F.floor(y / F.col("bh"))
    block = down * across + F.floor(x / F.col("bw"))
    place = (y % F.col("bh")) * F.col("bw") + x % F.col("bw")
    lines = F.when(wide > WIDE, F.col("bh")).otherwise(F.least("bh", high - down * F.col("bh")))  # the last stripe ends with the raster
    placed = rows.join(span, "raster").select("raster", block.cast("long").alias("block"), place.cast("int").alias("place"), (lines * F.col("bw")).cast("int").alias("size"), F.col("value").cast("double").alias("value"))
    # In a task the pixels of a block follow each other, and of a pixel's values the largest is the last; null is below all, NaN above.
    placed = dealt(placed, pixels, "raster", "block").sortWithinPartitions("block", "raster", "value")

    def packed(batches):
        key, decoded, out, held, codec = None, np.empty(0, dtype="<f4"), [], 0, pa.Codec("zstd", 1)

        def batched():
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())], ["raster", "block", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).dictionary_encode()
            name, k, place, size = names.indices.to_numpy(), *(batch.column(c).to_numpy() for c in (1, 2, 3))
            names, value = names.dictionary.to_pylist(), batch.column(4).to_numpy(zero_copy_only=False).astype("<f4")
            cuts = (np.flatnonzero((name[1:] != name[:-1]) | (k[1:] != k[:-1])) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(k)], strict=True):
                now = names[name[a]], int(k[a])
                if now != key:
                    if key is not None:
                        out.append((*key, codec.compress(decoded, asbytes=True)))
                        held += len(out[-1][2])
                        if len(out) >= BATCH_BLOCKS or held >= BATCH_BYTES:
                            yield batched()
                            out, held = [], 0
                    key, decoded = now, decoded if len(decoded) == size[a] else np.empty(size[a], dtype="<f4")
                    decoded.fill(nodata)
                decoded[place[a:b]] = value[a:b]
        if key is not None:
            out.append((*key, codec.compress(decoded, asbytes=True)))
            yield batched()

    made = placed.mapInArrow(packed, "raster string, block long, data binary").join(span, "raster")

    def told(name, whole):
        data = whole.content()
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, len(data)], np.int32)), pa.py_buffer(data)])], ["raster", "content"])

    def joined(batches):
        name = whole = None
        for batch in batches:
            rasters, ks, data = (batch.column(c) for c in ("raster", "block", "data"))
            for i, (r, k) in enumerate(zip(rasters.to_pylist(), ks.to_pylist(), strict=True)):
                if r != name:
                    if whole is not None:
                        yield told(name, whole)
                    c0, c1, r0, r1, bw, bh = (batch.column(c)[i].as_py() for c in ("c0", "c1", "r0", "r1", "bw", "bh"))
                    wide, high = c1 - c0 + 1, r1 - r0 + 1
                    name, whole = r, _File(wide, high, bh, west + c0 * step, north - r0 * step, step, step, epsg, nodata, compression=_ZSTD, tile=bw if wide > WIDE else None)
                whole.add(k, data[i].as_buffer())
        if whole is not None:
            yield told(name, whole)

    return dealt(made, pixels + parts, "raster").sortWithinPartitions("raster", "block").mapInArrow(joined, "raster string, content binary")


class _File:
    """A little-endian TIFF file in the making, of packed stripes of some rows, or of tiles of that height; those that are not added are left out."""

    def __init__(self, width: int, height: int, rows: int, west: float, north: float, dx: float, dy: float, epsg: int, nodata: float | None, kind: str = "f4", compression: int = _DEFLATE, tile: int | None = None):
        geographic = epsg == 4326
        keys = [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, _RASTER_TYPE, 0, 1, 1, _GEOGRAPHIC if geographic else _PROJECTED, 0, 1, epsg]
        n = -(-width // (tile or width)) * -(-height // rows)
        self.data, self.offsets, self.sizes = bytearray(8), np.zeros(n, "<u4"), np.zeros(n, "<u4")
        layout = [(273, "I", self.offsets), (278, "I", [rows]), (279, "I", self.sizes)] if tile is None else [(322, "I", [tile]), (323, "I", [rows]), (324, "I", self.offsets), (325, "I", self.sizes)]
        self.tags = [
            (256, "I", [width]), (257, "I", [height]), (258, "H", [int(kind[1]) * 8]), (259, "H", [compression]), (262, "H", [1]), (277, "H", [1]), *layout,
            (339, "H", [{"u": 1, "i": 2, "f": 3}[kind[0]]]), (33550, "d", [dx, dy, 0.0]), (33922, "d", [0.0, 0.0, 0.0, west, north, 0.0]), (34735, "H", keys if epsg else keys[:4]),
        ]
        if nodata is not None:
            self.tags.append((42113, "s", f"{nodata:g}".encode() + b"\0"))
        self.tags.sort(key=lambda t: t[0])

    def add(self, k: int, packed: bytes) -> None:
        if len(self.data) + len(packed) + 16 * len(self.sizes) >= 1 << 32:
            raise RasterError("a file of over 4 GB")
        if len(packed):
            self.offsets[k], self.sizes[k] = len(self.data), len(packed)
            self.data += packed

    def content(self) -> bytearray:
        """The whole file; nothing can be added any more."""
        out = self.data
        out += b"\0" * (len(out) % 2)
        place, code = len(out), {v: k for k, v in _TYPES.items()}
        at = place + 2 + 12 * len(self.tags) + 4
        table, rest = b"", []
        for tag, t, values in self.tags:
            raw = values if t == "s" else np.asarray(values, dtype=f"<{np.dtype(t).str[1:]}").data.cast("B")  # the longest ones are not copied
            table += struct.pack("<HHI", tag, code[t], len(values))
            if len(raw) <= 4:
                table += bytes(raw).ljust(4, b"\0")
            else:
                table += struct.pack("<I", at)
                rest += [raw, b"\0" * (len(raw) % 2)]
                at += len(raw) + len(raw) % 2
        out[:8] = b"II" + struct.pack("<HI", 42, place)
        out += struct.pack("<H", len(self.tags)) + table + struct.pack("<I", 0)
        for raw in rest:
            out += raw
        return out


def assemble(stripes: list[bytes], width: int, height: int, rows: int, west: float, north: float, dx: float, dy: float, epsg: int, nodata: float | None, kind: str = "f4", compression: int = _DEFLATE, tile: int | None = None) -> bytes:
    """A file of all its stripes or tiles in order; empty ones are left out."""
    whole = _File(width, height, rows, west, north, dx, dy, epsg, nodata, kind, compression, tile)
    for k, s in enumerate(stripes):
        whole.add(k, s)
    return bytes(whole.content())


def grid_files(rows: DataFrame) -> DataFrame:
    """Rasters (raster, col, row, value) on the index's grid as files in degrees."""
    return encode(rows, grid.ORIGIN_X, grid.ORIGIN_Y, grid.RESOLUTION)
