"""A Merkle manifest of a table: a digest for each row, group and the whole, and a proof that ties each row to the whole.

Rows of a group, in the order of their ids, are the leaves of a tree of eight branches; the groups' roots, in the order of
the groups, are those of the tree above. Ranks come from range partitions and prefix sums. Every aligned block of
FAN ** LEVELS neighbouring rows is one task's unit: in it, treehash stacks run ahead of the leaf in turn and hand over each
level's next run of nodes when it is due, so that authentication paths advance leaf by leaf with a few nodes a level. The
blocks' own roots are leaves of the next such step, until a group has one; these upper paths are shared by all of a block.

Nulls: a null in any column is a digest's `-`; rows of a null group are a group, the first one; null ids come first in their
group and are not altered. Ties: rows of one id are ordered by digest; rows that are equal throughout are leaves each. A group
of one row has its leaf as root, a table of one group that group's root. Texts are digested whole in the JVM. An empty table
has no rows. Other columns of the table take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches, if_few, lasting, look_up, release

FAN = 8
#: Levels of a block's tree: FAN ** LEVELS rows are gathered in one value.
LEVELS = 3

_PATH = "path array<struct<place:int,others:array<string>>>"


def field(value: Column) -> Column:
    """A value as it goes into a digest: `-`, or its length in UTF-8 bytes, a colon, and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def leaves(docs: DataFrame, columns: list[str], group: str, id_col: str, altered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(grp, id, leaf, other) of each row. other is the digest with the altered columns where `where` holds, else null.

    grp is the group as text after a sign that sorts behind the empty text, which stands for null.
    """
    other = F.lit(None).cast("binary")
    if altered:
        other = F.when(where, F.unhex(digest(*[altered.get(c, F.col(c)) for c in columns])))
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("grp"), F.col(id_col).alias("id"),
        F.unhex(digest(*[F.col(c) for c in columns])).alias("leaf"), other.alias("other"),
    )


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (written already) with their rank in grp, from 0, and the number n of rows in it; no window holds a whole group.

    Rows are range-partitioned and written in order; the sizes of the parts of a group before give the rest of a rank.
    """
    by = [F.col(c).asc_nulls_first() for c in ("grp", *order)] + [F.col("tie")]  # the tie spreads rows that are equal
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("tie")
    place = F.monotonically_increasing_id()
    placed = lasting(ranged.select("*", F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("place")))
    sizes = placed.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("here"), F.min("place").alias("first"))
    group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("here").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = lasting(sizes.select("grp", "part", (before - F.col("first")).alias("shift"), F.sum("here").over(group).alias("n")))
    starts = if_few(starts, weight=F.octet_length("grp") + 40)
    return placed.join(starts, ["grp", "part"]).withColumn("rank", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def blocked(rows: DataFrame, levels: int, *kept: str) -> DataFrame:
    """Rows (grp, rank, n, node, kept) by aligned blocks of at most FAN ** levels: (grp, block, n, members)."""
    member = F.struct("rank", "node", *kept)
    block = F.floor(F.col("rank") / FAN**levels).cast("long").alias("block")
    return rows.groupBy("grp", block).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(member)).alias("members"))


def _hash(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


class Treehash:
    """Takes leaves one at a time; holds fewer than FAN open nodes of each lower level, and the nodes of its own level."""

    def __init__(self, level: int):
        self.open: list[list[str]] = [[] for _ in range(level + 1)]

    def push(self, node: str) -> None:
        for row in self.open[:-1]:
            row.append(node)
            if len(row) < FAN:
                return
            node = _hash(row)
            row.clear()
        self.open[-1].append(node)

    def close(self) -> list[str]:
        """The nodes of its level, after runs that the leaves do not fill."""
        for below, above in zip(self.open, self.open[1:], strict=False):
            if below:
                above.append(_hash(below))
        return self.open[-1]


def levels_of(n: int, most: int) -> int:
    """Levels of the tree of a block of a group of n rows: up to the group's root, or a block's."""
    height = 0
    while n > 1 and height < most:
        n, height = -(-n // FAN), height + 1
    return height


def head(nodes: list[str], levels: int) -> str:
    stack = Treehash(levels)
    for x in nodes:
        stack.push(x)
    return stack.close()[0]


def traverse(nodes: list[str], levels: int) -> Iterator[list[tuple[int, list[str]]]]:
    """For each leaf in turn, its place in a run and the run's nodes, level by level.

    A level's stack takes one leaf of the next run at each step, and is done when that run begins.
    """
    now, ahead = [], [Treehash(k) for k in range(levels)]
    for k in range(levels):
        stack = Treehash(k)
        for x in nodes[: FAN ** (k + 1)]:
            stack.push(x)
        now.append(stack.close())
    for i in range(len(nodes)):
        yield [(i // FAN**k % FAN, now[k]) for k in range(levels)]
        for k in range(levels):
            run = FAN ** (k + 1)
            due = (i // run + 1) * run + i % run
            if due < len(nodes):
                ahead[k].push(nodes[due])
            if (i + 1) % run == 0:
                now[k], ahead[k] = ahead[k].close(), Treehash(k)


def fold(node: str, path: list[tuple[int, list[str]]]) -> str:
    """The node at the end of a path of (place, others)."""
    for place, others in path:
        node = _hash([*others[:place], node, *others[place:]])
    return node


def _others(steps: list[tuple[int, list[str]]]) -> list[tuple[int, list[str]]]:
    return [(place, run[:place] + run[place + 1 :]) for place, run in steps]


def _text(nodes: pa.Array) -> list[str]:
    return [x.hex() for x in nodes.to_pylist()]


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[dict, pa.StructArray]]:
    """Each block's other columns and its members."""
    rest = [c for c in batch.schema.names if c != "members"]
    rows, members = batch.select(rest).to_pylist(), batch.column(batch.schema.names.index("members"))
    for k, row in enumerate(rows):
        yield row, members[k].values


def _heads(blocks: DataFrame, levels: int) -> DataFrame:
    """(grp, rank, n, node): each block's root as a leaf of the tree above."""

    def run(batches):
        for batch in batches:
            out = [(r["grp"], r["block"], -(-r["n"] // FAN**levels), bytes.fromhex(head(_text(m.field("node")), levels_of(r["n"], levels)))) for r, m in _blocks(batch)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["grp", "rank", "n", "node"])

    return bounded_batches(blocks).mapInArrow(run, "grp string, rank long, n long, node binary")


def _upper(heads: DataFrame, levels: int) -> DataFrame:
    """(grp, block, path, top) of each block: the path from its root to that of its group. heads are written already."""
    none = F.array().cast("array<struct<place:int,others:array<string>>>")
    done = heads.where("n = 1").select("grp", F.col("rank").alias("block"), none.alias("path"), F.lower(F.hex("node")).alias("top"))
    more = heads.where("n > 1")
    return done if more.isEmpty() else done.unionByName(paths(more, levels))


def climbed(blocks: DataFrame, levels: int) -> DataFrame:
    """(grp, block, path, top) of each of blocks (written already): its root's way, and its group's root."""
    return _upper(lasting(_heads(blocks, levels)), levels)


def paths(nodes: DataFrame, levels: int) -> DataFrame:
    """(grp, block, path, top) of each node (grp, rank, n, node): its way to its group's root; block is its rank."""

    def run(batches):
        for batch in batches:
            out = []
            for r, m in _blocks(batch):
                above = [(p["place"], p["others"]) for p in r["path"]]
                for rank, steps in zip(m.field("rank").to_pylist(), traverse(_text(m.field("node")), levels_of(r["n"], levels)), strict=True):
                    way = [{"place": place, "others": others} for place, others in _others(steps) + above]
                    out.append((r["grp"], rank, way, r["top"]))
            if out:
                kinds = (pa.string(), pa.int64(), pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))])), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["grp", "block", "path", "top"])

    blocks = lasting(blocked(nodes, levels))
    whole = blocks.join(climbed(blocks, levels), ["grp", "block"])
    return lasting(bounded_batches(whole).mapInArrow(run, f"grp string, block long, {_PATH}, top string"))


def manifest(leaves: DataFrame, proofs: bool = False, levels: int = LEVELS) -> DataFrame:
    """(grp, id, leaf, subroot, root, proof_sha256, folded_root, verified) of each of leaves.

    folded_root comes from `other`, or else the leaf, and the siblings of the table as it is; verified tells whether it is the
    root. proofs: also the siblings themselves (path: place and others, level by level). levels: those of a block.
    """
    id_type = leaves.schema["id"].dataType
    found = lasting(leaves)
    blocks = lasting(blocked(ranked(found, ["id", "leaf"]).withColumnRenamed("leaf", "node"), levels, "id", "other"))
    release(found)
    upper = lasting(climbed(blocks, levels))
    tops = lasting(upper.select(F.col("grp").alias("of"), "top").distinct())
    whole = ranked(tops.select(F.lit("").alias("grp"), "of", F.unhex("top").alias("node")), ["of"])
    numbered = lasting(whole)
    last = paths(numbered, levels).select(F.col("block").alias("rank"), F.col("path").alias("last"), F.col("top").alias("root"))
    last = lasting(numbered.join(last, "rank").select(F.col("of").alias("grp"), "last", "root"))
    ways = look_up(upper, last, "grp", weight=F.octet_length("grp") + F.size("last") * FAN * 80 + 80)
    full = blocks.join(ways.select("grp", "block", F.concat("path", "last").alias("path"), "top", "root"), ["grp", "block"])

    names = ["grp", "id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    schema = T.StructType([T.StructField(c, id_type if c == "id" else T.BooleanType() if c == "verified" else T.StringType()) for c in names])
    if proofs:
        schema = schema.add("path", T.ArrayType(T.StructType([T.StructField("place", T.IntegerType()), T.StructField("others", T.ArrayType(T.StringType()))])))

    def run(batches):
        for batch in batches:
            for r, m in _blocks(batch):
                above = [(p["place"], p["others"]) for p in r["path"]]
                shared, known = "".join(x for _, others in above for x in others), {}
                nodes, others_text = _text(m.field("node")), m.field("other").to_pylist()
                proof, folded, ways = [], [], []
                for node, other, steps in zip(nodes, others_text, traverse(nodes, levels_of(r["n"], levels)), strict=True):
                    own = _others(steps)
                    proof.append(_hash([x for _, others in own for x in others] + [shared]))
                    at = fold(node if other is None else other.hex(), own)
                    if at not in known:
                        known[at] = fold(at, above)
                    folded.append(known[at])
                    if proofs:
                        ways.append([{"place": place, "others": others} for place, others in own + above])
                same = lambda x: pa.array([x] * len(nodes), pa.string())  # noqa: B023, E731
                columns = [same(r["grp"]), m.field("id"), pa.array(nodes), same(r["top"]), same(r["root"]), pa.array(proof), pa.array(folded), pa.array([x == r["root"] for x in folded])]
                if proofs:
                    columns.append(pa.array(ways, pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))]))))
                yield pa.RecordBatch.from_arrays(columns, names + ["path"] * proofs)

    return bounded_batches(full).mapInArrow(run, schema)
