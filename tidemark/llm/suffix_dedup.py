"""Repeated byte strings over all documents, by longest-previous-factor arrays on blocks of suffixes.

A window is a string of LENGTH bytes within one document. A window is repeated if an equal one starts anywhere else,
in the same document or another. Suffixes have to be compared only with those that can share LENGTH bytes, so they are
first dealt into blocks by an anchor: the least of the window's hashed GRAM-byte strings (the leftmost at ties). Equal
windows have equal anchors, and neighbouring windows mostly share theirs; such a run of windows is one row.

Runs whose anchor occurs once are dropped. Where all runs of an anchor are equal as a whole, all their windows are
repeated, and no text is needed. For the rest, one run of each distinct content is fetched, and the suffixes of a block
are sorted by their first LENGTH bytes (ranks of 8, 24, 72, ... bytes). In this suffix order the nearest suffixes before
and after that start at a smaller position are found for each suffix, and the longer of its common prefixes with the two
is its longest previous factor. A window with a factor of LENGTH has an earlier copy there, and that copy a later one.
The suffixes of an anchor with more than HOT contents are too many for one task; they are dealt by their whole first
LENGTH bytes instead, and an aggregate gives the least position among equal ones, which is the same answer.

Without keep_first every byte of every repeated window goes; with it, windows whose copy is the first (by id, then
place) stay. A run is told by two 64-bit hashes, of its anchor and of its content; a document by its id and a hash.

Texts are shuffled once: to meet the runs that are asked of them, and again, from the same exchange, to be cut.

Cases: a null text counts as empty; texts shorter than LENGTH bytes lose nothing; rows repeated with their id are copies
like any other; documents with a null id come first; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, lasting, look_up
from tidemark.llm.shingles import _T, batches, mix, powers

LENGTH = 200
GRAM = 32
HOT = 4096
BLOCK_BYTES = 1 << 19
PIECE = 1 << 20
#: Stands for a null id; it comes before all others.
NO_ID = -(1 << 63)
RUN = ["anchor", "content"]

_RANGES = "array<struct<a:int,b:int>>"


def _hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and inverse powers, from which the hash of any slice follows."""
    r, inv = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_T[buf] * r[: len(buf)], out=total[1:])
    return total, inv


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def text_runs(raw: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Arrays (document, start, n, anchor, content): runs of windows of the texts that share an anchor."""
    ends = np.cumsum(np.array([len(x) for x in raw], dtype=np.int64))
    buf = np.frombuffer(b"".join(raw), dtype=np.uint8)
    if len(buf) < length:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    total, inv = _hashes(buf)
    grams = mix((total[gram:] - total[:-gram]) * inv[: len(buf) - gram + 1])
    place = np.uint64((1 << 24) - 1)  # pieces are shorter
    keys = (grams & ~place) | (np.arange(len(grams), dtype=np.uint64) & place)
    anchor = (_least(keys, length - gram + 1) & place).astype(np.int64)
    starts = np.arange(len(anchor), dtype=np.int64)
    doc = np.repeat(np.arange(len(raw)), [len(x) for x in raw])[: len(anchor)]
    inside = starts + length <= ends[doc]
    starts, anchor, doc = starts[inside], anchor[inside], doc[inside]
    if not len(starts):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(starts)))
    doc, at = doc[first], anchor[first]
    begin = starts[first]
    stop = begin + n + (length - 1)
    content = mix((total[stop] - total[begin]) * inv[begin] + (at - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + n.astype(np.uint64))
    base = np.concatenate(([0], ends[:-1]))[doc]
    return doc, begin - base, n, grams[at].view(np.int64), content.view(np.int64)


def _pieces(texts, length: int):
    """Lists of (row, offset, bytes) of some texts, of about PIECE bytes together; a longer text is cut so that each
    window is in one piece."""
    held, size = [], 0
    for row, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        for offset in range(0, len(raw) - length + 1, PIECE):
            held.append((row, offset, raw[offset : offset + PIECE + length - 1]))
            size += len(held[-1][2])
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def window_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Runs whose anchor may occur again, of documents (id, uid, text): rows (anchor, content, id, uid, start, n).

    Runs whose anchor occurs again in their own list of pieces stay in any case and are dealt freely; one row without
    windows (n = 0) tells the anchor's partition of them, where runs that are alone in their list meet. They come sorted,
    so a task holds one batch of them.
    """
    names = ["anchor", "content", "id", "uid", "start", "n", "known"]

    def run(parts):
        import pyarrow as pa

        for part in parts:
            ids, uids = part.column(0).to_numpy(), part.column(1).to_numpy()
            for pieces in _pieces((t for (some,) in batches(part.column(2)) for t in some), length):
                doc, start, n, anchor, content = text_runs([x for _, _, x in pieces], length, gram)
                row, offset = (np.array([x[k] for x in pieces], dtype=np.int64)[doc] for k in (0, 1))
                several, of, count = np.unique(anchor, return_inverse=True, return_counts=True)
                cols = [anchor, content, ids[row], uids[row], start + offset, n, count[of] > 1]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)
                told = several[count > 1]
                zero = np.zeros(len(told), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (told, zero, zero, zero, zero, zero, zero > 0)], names=names)

    def again(parts):
        import pyarrow as pa

        def kept(table, keep):
            keep |= table.column("known").to_numpy()
            keep &= table.column("n").to_numpy() > 0
            return table.filter(pa.array(keep)).drop_columns(["known"]).to_batches()

        held = None  # the last row, of which the next batch tells whether its anchor occurs again
        before = None  # the anchor of the row before it
        for part in parts:
            if not len(part):
                continue
            table = pa.Table.from_batches([part])
            if held is not None:
                table = pa.concat_tables([held, table])
            anchor = table.column("anchor").to_numpy()
            same = anchor[1:] == anchor[:-1]
            keep = np.concatenate(([before is not None and anchor[0] == before], same))
            keep[:-1] |= same
            yield from kept(table.slice(0, len(anchor) - 1), keep[:-1])
            held, before = table.slice(len(anchor) - 1), anchor[-2] if len(anchor) > 1 else before
        if held is not None:
            yield from kept(held, np.array([before is not None and held.column("anchor")[0].as_py() == before]))

    schema = "anchor long, content long, id long, uid long, start long, n long"
    found = docs.select("id", "uid", "text").mapInArrow(run, schema + ", known boolean")
    dealt = found.repartition(F.when(F.col("known"), F.xxhash64("uid", "start")).otherwise(F.col("anchor"))).sortWithinPartitions("anchor")
    return lasting(dealt.mapInArrow(again, schema))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
                   keep_first: bool = False, hot: int = HOT) -> DataFrame:
    """Rows (id, uid, a, b): bytes a to b (exclusive) of a document to be removed; they may overlap. uid is a hash of
    id and text; NO_ID stands for a null id."""
    return _spans(_source(docs, id_col, text_col), length, gram, keep_first, hot)


def _spans(source: DataFrame, length: int, gram: int, keep_first: bool, hot: int) -> DataFrame:
    runs = window_runs(source, length, gram)
    place = F.struct("id", "uid", "start")
    anchors = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), (F.min("content") == F.max("content")).alias("whole"), F.min(place).alias("first"))
    anchors = lasting(anchors.where("c > 1").drop("c"), runs.count())
    found = lasting(look_up(runs, anchors, "anchor", weight=F.lit(48)).where("whole IS NOT NULL"))
    whole = found.where("whole")
    if keep_first:
        whole = whole.where(place != F.col("first"))
    whole = whole.select("id", "uid", F.col("start").alias("a"), (F.col("start") + F.col("n") - 1 + length).alias("b"))
    mixed = found.where("NOT whole").drop("whole", "first")

    distinct = lasting(mixed.groupBy(*RUN).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "uid", "start", "n")).alias("r")))
    many = lasting(distinct.groupBy("anchor").count().where(F.col("count") > hot).select("anchor", F.lit(True).alias("many")))
    distinct = look_up(distinct, many, "anchor")
    block = _fetched(source, distinct.where("many IS NULL"), length).repartition("anchor").sortWithinPartitions(*RUN)
    ranges = block.mapInArrow(_suffix_matcher(length), f"anchor long, content long, dup {_RANGES}, later {_RANGES}")
    if not many.isEmpty():
        ranges = ranges.unionByName(_hot_ranges(_fetched(source, distinct.where("many"), length), length))

    ranged = mixed.join(ranges, RUN)
    chosen = F.col("dup")
    if keep_first:
        ranged = ranged.join(distinct.select(*RUN, "r"), RUN)
        chosen = F.when(F.struct("id", "uid", "start", "n") == F.col("r"), F.col("later")).otherwise(chosen)
    parts = ranged.select("id", "uid", "start", F.explode(chosen).alias("x"))
    spans = parts.select("id", "uid", (F.col("start") + F.col("x.a")).alias("a"), (F.col("start") + F.col("x.b") - 1 + length).alias("b"))
    return spans.unionByName(whole)


def _hot_ranges(fetched: DataFrame, length: int) -> DataFrame:
    """What the suffix matcher gives, for anchors with very many contents: suffixes are dealt by their first bytes."""
    wins = fetched.dropDuplicates(RUN).mapInArrow(_window_rows(length), "anchor long, content long, i int, c long, id long, uid long, start long, win long")
    classes = wins.groupBy("anchor", "win").agg(F.sum("c").alias("total"), F.min(F.struct("id", "uid", "start")).alias("first")).where("total > 1")
    later = F.when(F.struct("id", "uid", "start") != F.col("first"), F.col("i"))
    found = wins.join(classes, ["anchor", "win"]).groupBy(*RUN).agg(F.collect_list("i").alias("dup"), F.collect_list(later).alias("later"))

    def run(parts):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for part in parts:
            cols = [pa.array([_joined(sorted(x)) for x in part.column(k).to_pylist()], kind) for k in (2, 3)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=[*RUN, "dup", "later"])

    return found.mapInArrow(run, f"anchor long, content long, dup {_RANGES}, later {_RANGES}")


def _joined(windows: list[int]) -> list[dict]:
    """Ranges of consecutive windows."""
    out: list[dict] = []
    for i in windows:
        if out and out[-1]["b"] == i:
            out[-1]["b"] = i + 1
        else:
            out.append({"a": i, "b": i + 1})
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
                   keep_first: bool = False, hot: int = HOT) -> DataFrame:
    """One row per document: id, n_bytes, spans (maximal removed runs of bytes, end exclusive), kept (the other bytes)."""
    source = _source(docs, id_col, text_col)
    found = _spans(source, length, gram, keep_first, hot)
    spans = found.groupBy("id", "uid").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("cut"))
    cut = spans.mapInArrow(_merged, "id long, uid long, cut array<struct<a:long,b:long>>")

    def kept(text: str | None, spans: list[dict] | None) -> bytes:
        raw = (text or "").encode("utf-8", "surrogatepass")
        edges = [0, *(x for s in spans or () for x in (s["a"], s["b"])), len(raw)]
        return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))

    def run(parts):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for part in parts:
            at = 0
            for (texts,) in batches(part.column(2)):
                spans = part.column(3).slice(at, len(texts)).to_pylist()
                ids = part.column(0).slice(at, len(texts)).to_pylist()
                at += len(texts)
                rest = [kept(t, x) for t, x in zip(texts, spans, strict=True)]
                sizes = [len(k) + sum(s["b"] - s["a"] for s in x or ()) for k, x in zip(rest, spans, strict=True)]
                cols = [pa.array([None if i == NO_ID else i for i in ids], pa.int64()), pa.array(sizes, pa.int64()), pa.array([x or [] for x in spans], kind), pa.array(rest, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n_bytes", "spans", "kept"])

    rows = source.join(cut, ["id", "uid"], "left").select("id", "uid", "text", "cut")
    return rows.mapInArrow(run, "id long, n_bytes long, spans array<struct<a:long,b:long>>, kept binary").withColumnRenamed("id", id_col)


def _merged(parts):
    """Sorted spans that touch or overlap as one."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    for part in parts:
        out = []
        for spans in part.column(2).to_pylist():
            merged = []
            for s in spans:
                if merged and s["a"] <= merged[-1]["b"]:
                    merged[-1]["b"] = max(merged[-1]["b"], s["b"])
                else:
                    merged.append(s)
            out.append(merged)
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, kind)], names=["id", "uid", "cut"])


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = bounded_batches(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    return rows.withColumn("uid", F.xxhash64("id", "text"))


def _fetched(source: DataFrame, distinct: DataFrame, length: int) -> DataFrame:
    """distinct with the bytes of each row's run; repeated documents give repeated rows."""
    asked = distinct.groupBy("r.id", "r.uid").agg(F.collect_list(F.struct("anchor", "content", "c", "r.start", "r.n")).alias("runs"))
    names = ["anchor", "content", "c", "id", "uid", "start", "raw"]

    def run(parts):
        import pyarrow as pa

        types = [pa.int64()] * 6 + [pa.binary()]
        for part in parts:
            at = 0
            for (texts,) in batches(part.column(2)):
                ids, uids, runs = (part.column(c).slice(at, len(texts)).to_pylist() for c in (0, 1, 3))
                at += len(texts)
                out = []
                for doc, uid, text, of in zip(ids, uids, texts, runs, strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    out += [(x["anchor"], x["content"], x["c"], doc, uid, x["start"], raw[x["start"] : x["start"] + x["n"] + length - 1]) for x in of]
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    rows = source.join(asked, ["id", "uid"]).select("id", "uid", "text", "runs")
    return rows.mapInArrow(run, "anchor long, content long, c long, id long, uid long, start long, raw binary")


def _suffix_matcher(length: int):
    """Judges the windows of all runs of an anchor, which come sorted: ranges of them that are repeated, and that have an
    earlier copy. Whole anchors are judged together, some BLOCK_BYTES at once."""

    def run(parts):
        import pyarrow as pa
        import pyarrow.compute as pc

        held, size = [], 0

        def block(final):
            nonlocal held, size
            table = pa.Table.from_batches(held).combine_chunks()
            anchor, content = (table.column(c).to_numpy() for c in RUN)
            new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])))
            table, anchor = table.filter(pa.array(new)), anchor[new]
            edge = np.append(np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))), len(anchor))
            edge = edge if final else edge[:-1]  # the last anchor may go on
            total, a = np.concatenate(([0], np.cumsum(pc.binary_length(table.column("raw")).to_numpy()))), 0
            for k in range(1, len(edge)):
                if k == len(edge) - 1 or total[edge[k + 1]] - total[a] > BLOCK_BYTES:
                    yield _judged(table.slice(a, edge[k] - a), length)
                    a = edge[k]
            held = table.slice(a).to_batches()
            size = 0

        for part in parts:
            if len(part):
                held.append(part)
                size += len(part) * (2 * length)
                if size > 4 * BLOCK_BYTES:
                    yield from block(False)
        if held:
            yield from block(True)

    return run


def _judged(table, length: int):
    import pyarrow as pa

    raw, count = table.column("raw").to_pylist(), table.column("c").to_numpy()
    order = np.lexsort([table.column(c).to_numpy() for c in ("start", "uid", "id")])
    anchor, content = (table.column(c).to_numpy()[order] for c in RUN)
    sizes = np.array([len(raw[i]) for i in order])
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    buf = np.frombuffer(b"".join(raw[i] for i in order), dtype=np.uint8)
    n = sizes - length + 1
    bounds = np.cumsum(n) - n
    of = np.repeat(np.arange(len(order)), n)
    position = np.arange(n.sum()) - bounds[of] + begin[of]
    lpf, source = longest_previous_factors(buf, position, length)
    earlier = lpf >= length
    repeated = earlier | (count[order] > 1)[of]
    repeated[source[earlier]] = True  # the earlier copy has a later one
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    dup, before = (_ranges(x, bounds, n) for x in (repeated, earlier))
    return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(content), pa.array(dup, kind), pa.array(before, kind)], names=[*RUN, "dup", "later"])


def longest_previous_factors(buf: np.ndarray, position: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the suffixes of buf at these ascending positions: the length, up to `length`, of the longest prefix that also
    starts at an earlier one of them, and the index of such an earlier one (-1 where that length is 0)."""
    levels = _ranks(buf, length)
    rank = levels[length][position]
    order = np.argsort(rank, kind="stable")  # suffix order; of equal prefixes, the smaller position first
    lpf, source = np.zeros(len(order), dtype=np.int64), np.full(len(order), -1)
    for near in (_smaller_before(order), len(order) - 1 - _smaller_before(order[::-1])[::-1]):
        has = (near >= 0) & (near < len(order))
        i, j = order[has], order[near[has]]
        common = _common_prefix(levels, buf, position[i], position[j], length)
        better = common > lpf[i]
        lpf[i[better]], source[i[better]] = common[better], j[better]
    return lpf, source


def _smaller_before(values: np.ndarray) -> np.ndarray:
    """For each of some distinct values the index of the nearest smaller one before it, or -1.

    All between an index and the one it points to are larger, so a pointer to a larger value may take over that one's
    pointer; pointers so double their reach each round.
    """
    near = np.arange(len(values)) - 1
    open_ = np.flatnonzero(near >= 0)
    while len(open_):
        at = near[open_]
        larger = values[at] > values[open_]
        open_ = open_[larger]
        near[open_] = near[at[larger]]
        open_ = open_[near[open_] >= 0]
    return near


def _common_prefix(levels: dict[int, np.ndarray], buf: np.ndarray, i: np.ndarray, j: np.ndarray, length: int) -> np.ndarray:
    """How many bytes, up to `length`, the suffixes at i and j share: compared in pieces of falling size by their ranks."""
    common = np.where(levels[length][i] == levels[length][j], length, 0)
    open_ = np.flatnonzero(common == 0)
    for size in sorted((x for x in levels if x < length), reverse=True):
        rank = levels[size]
        going = open_
        for _ in range(length // size):
            at = common[going]
            fits = at + size <= length
            going, at = going[fits], at[fits]
            going = going[rank[i[going] + at] == rank[j[going] + at]]
            if not len(going):
                break
            common[going] += size
    ended = len(buf)
    going = open_
    for _ in range(min(levels) - 1):
        a, b = i[going] + common[going], j[going] + common[going]
        inside = (a < ended) & (b < ended) & (common[going] < length)
        going, a, b = going[inside], a[inside], b[inside]
        going = going[buf[a] == buf[b]]
        if not len(going):
            break
        common[going] += 1
    return common


def _ranks(buf: np.ndarray, length: int) -> dict[int, np.ndarray]:
    """For sizes from 8 up to `length` bytes, the rank of the so many bytes at each position among all positions: ranks of
    8 bytes, then of three (in very large blocks, two) such pieces, and so on."""
    padded = np.concatenate((buf, np.zeros(length + 8, dtype=np.uint8)))
    rank = np.zeros(len(buf) + length, dtype=np.uint64)
    have = min(8, length)
    for j in range(have):
        rank = (rank << np.uint64(8)) | padded[j : j + len(rank)]
    rank = _dense(rank)
    levels = {have: rank}
    three = len(rank) < 1 << 21  # three ranks fit in 63 bits
    while have < length:
        if three:
            new = min(3 * have, length)
            a, b = min(have, new - have), new - have
            rank = (rank[: len(rank) - b] << np.uint64(42)) | (rank[a : len(rank) - b + a] << np.uint64(21)) | rank[b:]
        else:
            new = min(2 * have, length)
            rank = (rank[: len(rank) - new + have] << np.uint64(32)) | rank[new - have :]
        have, rank = new, _dense(rank)
        levels[have] = rank
    return levels


def _dense(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    ordered = keys[order]
    out = np.empty(len(keys), dtype=np.uint64)
    out[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
    return out


def _ranges(mask: np.ndarray, begin: np.ndarray, n: np.ndarray) -> list[list[dict]]:
    """For each part of the mask (from begin, of n) the ranges in it that hold."""
    inside = np.zeros(len(mask), dtype=bool)
    inside[begin[1:]] = True  # a range ends where its part ends
    before = np.concatenate(([False], mask[:-1]))
    first = np.flatnonzero(mask & (~before | inside))
    after = np.concatenate((mask[1:], [False]))
    ends = np.concatenate((inside[1:], [True]))
    last = np.flatnonzero(mask & (~after | ends)) + 1
    part = np.searchsorted(begin, first, side="right") - 1
    out: list[list[dict]] = [[] for _ in range(len(n))]
    for k, a, b in zip(part.tolist(), (first - begin[part]).tolist(), (last - begin[part]).tolist(), strict=True):
        out[k].append({"a": a, "b": b})
    return out


def _window_rows(length: int):
    names = ["anchor", "content", "c", "id", "uid"]

    def run(parts):
        import pyarrow as pa

        for part in parts:
            for row in zip(*(part.column(part.schema.get_field_index(x)).to_pylist() for x in (*names, "start", "raw")), strict=True):
                *same, start, raw = row
                total, inv = _hashes(np.frombuffer(raw, dtype=np.uint8))
                n = len(raw) - length + 1
                win = mix((total[length:] - total[:n]) * inv[:n]).view(np.int64)
                anchor, content, c, doc, uid = (np.full(n, v) for v in same)
                i = np.arange(n)
                cols = [anchor, content, i.astype(np.int32), c, doc, uid, start + i, win]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["anchor", "content", "i", "c", "id", "uid", "start", "win"])

    return run
