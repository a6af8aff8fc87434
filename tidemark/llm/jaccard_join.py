"""Near duplicates: an exact Jaccard self-join on word shingles with set-relation skipping, and its components.

A document is the set of its distinct K-word shingles. Documents with equal sets form a class, and classes are joined
by prefix filtering: shingles are ordered from rare to common, and two sets that reach the threshold share one of their
first few. The order is: shingles not known to be common by hash, then the common ones by count. Counts come from all
documents, block by block (a shingle is counted where a block has it twice), and the table of common ones keeps the
COMMON most frequent; any order gives the same links, a good one gives few candidates.

Short index lists, of up to SHORT classes, give all their pairs with the number of shared prefix shingles; a pair goes on
only if that number, and what the rest of the sets can add, suffices. For the other lists, skipping uses relations between
sets, twice. Each list has a pivot, the class with the least position; first the others are compared with their pivots
only. What is linked to its pivot has its answers from it: within one component, nothing is compared again. Only classes
outside of their pivot's component are then compared with the rest of the list, and there whole blocks of the list are
skipped: a block is a range of set sizes and of positions, and a class looks only into those where the positions leave
room for enough shared shingles. Candidates are verified on the full sets. So a group of very many near copies costs about
one comparison for each.

Shared shingles are told by 64-bit hashes, and sets are compared shingle by shingle on these; equal sets by two such hashes,
mixed over the set. No list of a common shingle meets in one task: its rows are dealt by class, and pivots are aggregated.

Cases: null or empty texts, and texts without words, have no shingles and are linked with nothing; a text of fewer than
K words is one shingle; repeated rows are linked with each other (equal sets) unless empty; rows with a null id take
part, and a component of null ids alone has a null component_id; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, if_few, lasting, look_up, once, release, without
from tidemark.llm.components import components
from tidemark.llm.shingles import batches, mix, shingle_sets

K = 5
#: Two sets are linked from this share on, as a fraction.
SHARE = (4, 5)
COMMON = 1 << 18
COMMON_FROM = 6
BLOCK_SHINGLES = 1 << 22
#: Set sizes of one block differ by up to this factor, positions by up to this part of the set's size.
SIZE_STEP, POSITION_STEP = 1.1, 1 / 18
SHORT = 64
PAIRS = 1 << 18
#: Rows of sorted lists that a task judges at once.
LIST_ROWS = 1 << 17
HEAVY_PIVOT = 256


def class_keys(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent signed 64-bit hashes of a set."""
    with np.errstate(over="ignore"):
        mixed = mix(shingles)
        n = np.uint64(len(shingles))
        one = mixed.sum(dtype=np.uint64) + n * np.uint64(0x9E3779B97F4A7C15)
        two = mix(mixed + np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64) + n
    first, second = mix(np.array([one, two], dtype=np.uint64)).view(np.int64)
    return int(first), int(second)


def least_overlap(a: Column, b: Column) -> Column:
    """The fewest shared shingles with which sets of sizes a and b are linked."""
    p, q = SHARE
    return F.expr("0") + F.ceil((a + b) * F.lit(p) / F.lit(p + q))


def shingle_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> tuple[DataFrame, DataFrame, frozenset]:
    """Rows (id, n_shingles, class, row) of all documents, row a hash of id and text; (token, n) of shingles that blocks
    have more than once; and the first hashes that different sets share, whose classes go by the second hash.

    About n²/2**65 hashes clash among n sets, so that set stays small at any size.
    """

    def run(parts):
        import pyarrow as pa

        names = ["id", "n", "class", "other", "token", "row"]
        held, seen, size = [], set(), 0

        def common():
            if not held:
                return
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts > 1
            tokens, counts = tokens[keep].view(np.int64), counts[keep]
            none = pa.nulls(len(tokens), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(counts.astype(np.int64)), none, none, pa.array(tokens), none], names=names)

        for part in parts:
            sizes, keys = [], []
            for (texts,) in batches(part.column(1)):
                for s in shingle_sets(texts, k):
                    key = class_keys(s) if len(s) else (None, None)
                    sizes.append(len(s))
                    keys.append(key)
                    if len(s) and key not in seen:
                        seen.add(key)
                        held.append(s)
                        size += len(s)
                if size > BLOCK_SHINGLES:
                    yield from common()
                    held, seen, size = [], set(), 0
            cols = [pa.array([x[i] for x in keys], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), *cols, pa.nulls(len(sizes), pa.int64()), part.column(2)], names=names)
        yield from common()

    both = lasting(source_rows(docs, id_col, text_col).mapInArrow(run, "id long, n long, class long, other long, token long, row long"))
    rows = both.where("token IS NULL").select("id", F.col("n").alias("n_shingles"), "class", "other", "row")
    clashes = rows.groupBy("class").agg(F.min("other").alias("a"), F.max("other").alias("b")).where("a <> b")
    clashing = frozenset(r[0] for r in clashes.select("class").collect())
    if clashing:
        rows = rows.withColumn("class", F.when(F.col("class").isin(*clashing), F.col("other")).otherwise(F.col("class")))
    return rows.drop("other"), both.where("token IS NOT NULL").select("token", "n"), clashing


def common_shingles(counted: DataFrame, most: int | None = None) -> pd.DataFrame:
    """The `most` (COMMON) most frequent shingles with their counts, ordered by token: a table of bounded size."""
    total = counted.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_FROM)
    return total.orderBy(F.desc("n"), "token").limit(COMMON if most is None else most).toPandas().sort_values("token")


def postings(docs: DataFrame, common: pd.DataFrame, text_col: str = "text", k: int = K, clashing: frozenset = frozenset(), short: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The index lists of the classes' prefixes, without those of one class only.

    First the long lists (and all of common shingles) as rows (token, class, n, pos): pos is the position of the token in
    the class's set, in the common order, and n the set's size. Then the pairs of the short lists as rows (a, b, c, n, m):
    two classes, the number of their common tokens, their sizes. Lists come sorted to the tasks that judge them, which
    hold a bounded number of rows.
    """
    short = SHORT if short is None else short
    tokens, counts = common["token"].to_numpy(np.int64), common["n"].to_numpy(np.int64)

    def prefixes(parts):
        import pyarrow as pa

        for part in parts:
            seen = set()
            for (texts,) in batches(part.column(0)):
                out = []
                for s in shingle_sets(texts, k):
                    if not len(s) or (keys := class_keys(s)) in seen:
                        continue
                    seen.add(keys)
                    key = keys[1] if keys[0] in clashing else keys[0]
                    signed = s.view(np.int64)
                    at = np.minimum(np.searchsorted(tokens, signed), max(len(tokens) - 1, 0))
                    known = tokens[at] == signed if len(tokens) else np.zeros(len(s), dtype=bool)
                    first = len(s) - -(-len(s) * SHARE[0] // SHARE[1]) + 1
                    rare = np.flatnonzero(~known)[:first]
                    rest = np.flatnonzero(known)
                    rest = rest[np.argsort(counts[at[rest]], kind="stable")][: first - len(rare)]
                    chosen = np.concatenate((rare, rest))
                    out.append((signed[chosen], np.full(first, key), np.full(first, len(s)), np.arange(first), known[chosen]))
                if out:
                    cols = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, names=["token", "class", "n", "pos", "known"])

    def judged(token, key, size, pos, known):
        """Long lists and pairs of whole lists in sorted order; a list that was begun as a long one comes flagged as known."""
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        members = np.diff(np.append(first, len(token)))
        long = np.repeat(members > short, members) | known
        zero = np.zeros(np.count_nonzero(long), dtype=np.int64)
        yield _batch(token[long], key[long], zero, size[long], pos[long])
        for m in range(2, min(short, members.max()) + 1):
            lists = first[(members == m) & ~known[first]]
            x, y = np.triu_indices(m, 1)
            for at in range(0, len(lists), max(1, PAIRS // len(x))):
                at = lists[at : at + max(1, PAIRS // len(x)), None]
                left, right = (at + x).ravel(), (at + y).ravel()  # by key within a list, so left < right
                fits = (size[left] * SHARE[1] >= size[right] * SHARE[0]) & (size[right] * SHARE[1] >= size[left] * SHARE[0])
                left, right = left[fits], right[fits]
                if not len(left):
                    continue
                order = np.lexsort((key[right], key[left]))
                left, right = left[order], right[order]
                new = np.flatnonzero(np.concatenate(([True], (key[left][1:] != key[left][:-1]) | (key[right][1:] != key[right][:-1]))))
                count = np.diff(np.append(new, len(left)))
                left, right = left[new], right[new]
                yield _batch(key[left], key[right], count, size[left], size[right])

    def shared(parts):
        held, rows, begun, last = [], 0, None, None  # begun: the long list that goes on; last: its last class

        def work(final):
            nonlocal held, rows, begun, last
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            token, key = cols[:2]
            new = np.concatenate(([last is None or (token[0], key[0]) != last], (key[1:] != key[:-1]) | (token[1:] != token[:-1])))
            cols = [c[new] for c in cols]
            held, rows = [], 0
            if not len(cols[0]):
                return
            token = cols[0]
            cols[4] |= token == begun if begun is not None else False
            cut = len(token) if final else int(np.searchsorted(token, token[-1]))
            if len(token) - cut > short or (not final and token[-1] == begun):  # the list is long already: its rows go on
                cols[4][cut:] = True
                begun, last, cut = token[-1], (token[-1], cols[1][-1]), len(token)
            elif cut < len(token):
                held, rows, last = [[c[cut:] for c in cols]], len(token) - cut, None
            if cut:
                yield from judged(*(c[:cut] for c in cols))

        for part in parts:
            if len(part):
                held.append([part.column(c).to_numpy(zero_copy_only=False).copy() for c in ("token", "class", "n", "pos", "known")])
                rows += len(part)
                if rows >= LIST_ROWS:
                    yield from work(False)
        if held:
            yield from work(True)

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(prefixes, "token long, class long, n long, pos long, known boolean")
    dealt = found.repartition(F.when(F.col("known"), F.xxhash64("class", "token")).otherwise(F.col("token"))).sortWithinPartitions("token", "class")
    both = lasting(dealt.mapInArrow(shared, "a long, b long, c long, n long, m long"))
    lists = both.where("c = 0").select(F.col("a").alias("token"), F.col("b").alias("class"), "n", F.col("m").alias("pos"))
    return lists, both.where("c > 0")


def _batch(*columns: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["a", "b", "c", "n", "m"])


def promising(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of short lists whose shared prefix tokens, with those of long lists and the sets' rests, may suffice.

    All shared tokens up to the end of the prefix that ends first are in both prefixes; after it, that set has 4/5 of
    its tokens left, less one.
    """
    p, q = SHARE
    counted = lasting(pairs.groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("n").alias("n"), F.max("m").alias("m")), pairs.count())
    in_long = lasting(lists.groupBy("class").agg(F.count(F.lit(1)).alias("long")), lists.count())
    for side in ("a", "b"):
        of = in_long.select(F.col("class").alias(side), F.col("long").alias(f"long_{side}"))
        counted = look_up(counted, of, side)
    more = F.least(F.coalesce("long_a", F.lit(0)), F.coalesce("long_b", F.lit(0)))
    rest = F.ceil(F.greatest("n", "m") * p / q) - 1
    return counted.where(F.col("c") + more + rest >= least_overlap(F.col("n"), F.col("m"))).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable by links, its own included)."""
    rows, of_class = labelled(docs, id_col, text_col, k)
    return look_up(rows, of_class, "class").select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> tuple[DataFrame, DataFrame]:
    """Rows (id, n_shingles, class, row) of all documents, class null without shingles; and for each class (class, rep,
    row, label, component_id): the id and row key of one of its documents, its component's label and least id."""
    rows, counted, clashing = shingle_classes(docs, id_col, text_col, k)
    held = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    classes = lasting(rows.where("class IS NOT NULL").groupBy("class").agg(F.min(held).alias("r")).select("class", F.col("r.id").alias("rep"), F.col("r.row").alias("row")), rows.count())
    lists, short = postings(docs, common_shingles(counted), text_col, k, clashing)
    source = source_rows(docs, id_col, text_col)

    n = lists.count()
    pivots = lasting(lists.groupBy("token").agg(F.min(F.struct("pos", "class", "n")).alias("p")).select("token", "p.*"), n)
    to_pivot = look_up(lists, pivots.select("token", F.struct("class", "n", "pos").alias("y")), "token", weight=F.lit(40))
    of_lists = _possible(to_pivot.select(F.struct("class", "n", "pos").alias("x"), "y"), "x.class <> y.class")
    likely = promising(short, lists)
    first = lasting(of_lists.unionByName(likely).distinct(), n + short.count())
    found = lasting(linked(first, source, classes, k))
    labels = components(found)

    named = look_up(lists, labels, "class").withColumn("label", F.coalesce("label", "class"))
    of_pivot = lasting(look_up(pivots, labels, "class").select("token", F.coalesce("label", "class").alias("of_pivot")), n)
    outside = look_up(named, of_pivot, "token").where("label <> of_pivot").drop("of_pivot")
    second = _possible(_looking(outside).alias("x").join(_blocked(named).alias("y"), ["token", "size", "part"]), "x.label <> y.label")
    second = lasting(second.join(first, ["a", "b"], "left_anti"))
    more = lasting(linked(second, source, classes, k))
    labels = components(found.unionByName(more))
    release(first, second, found, more, pivots, of_pivot)

    named = classes.join(labels, "class", "left").select("class", "rep", "row", F.coalesce("label", "class").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    return rows, lasting(named.join(least, "label").select("class", "rep", "row", "label", "component_id"), classes.count())


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Of each component one row of docs, all columns: one with the smallest id. Rows without shingles all stay."""
    source, of_class = labelled(docs, id_col, text_col, k)
    found = lasting(look_up(source, of_class.select("class", "label"), "class").where("label IS NOT NULL").select("id", "row", "label"))
    rows = found.count()
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    groups = lasting(found.groupBy("label").agg(best, F.count(F.lit(1)).alias("n")).where("n > 1").select("label", "best"), rows)
    of_group = lasting(look_up(found, groups, "label").where("best IS NOT NULL").select("id", "row", (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("row") == F.col("best.row"))).alias("kept")), rows)
    again = lasting(of_group.where("kept").groupBy("id", "row").count().where("count > 1").select("id", "row"), rows)
    row = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))
    return once(without(docs, of_group.where("NOT kept").select("id", "row"), row, id_col), again, row, id_col)


def source_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.withColumn("row", F.xxhash64("id", "text"))


def _possible(pairs: DataFrame, where: str) -> DataFrame:
    """Distinct pairs (a, b), a < b, of classes x and y that sizes and positions in a list allow to be linked."""
    n, m = F.col("x.n"), F.col("y.n")
    room = F.least(n - F.col("x.pos"), m - F.col("y.pos"))
    fits = pairs.where(where).where((n * SHARE[1] >= m * SHARE[0]) & (m * SHARE[1] >= n * SHARE[0]) & (room >= least_overlap(n, m)))
    a, b = F.col("x.class"), F.col("y.class")
    return fits.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _size(n: Column) -> Column:
    return F.floor(F.log(n) / F.lit(float(np.log(SIZE_STEP)))).cast("int")


def _blocked(lists: DataFrame) -> DataFrame:
    return lists.withColumn("size", _size(F.col("n"))).withColumn("part", F.floor(F.col("pos") / F.col("n") / POSITION_STEP).cast("int"))


def _looking(lists: DataFrame) -> DataFrame:
    """A row for each block of the list that can hold a partner."""
    low, high = SHARE[0] / SHARE[1], SHARE[1] / SHARE[0]
    sizes = F.sequence(_size(F.ceil(F.col("n") * low)) - 1, _size(F.floor(F.col("n") * high - F.col("pos") * (1 + high)) + 1) + 1)
    rows = lists.where(F.col("n") * high - F.col("pos") * (1 + high) >= F.col("n") * low - 1).withColumn("size", F.explode(sizes))
    largest = F.pow(F.lit(SIZE_STEP), F.col("size") + 2)
    share = SHARE[0] / (SHARE[0] + SHARE[1])
    last = F.floor((F.lit(1 - share) - share * F.col("n") / largest) / POSITION_STEP).cast("int")
    return rows.withColumn("last", last).where("last >= 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")


def linked(pairs: DataFrame, source: DataFrame, classes: DataFrame, k: int = K) -> DataFrame:
    """Those of the pairs (a, b) of classes whose full sets reach the threshold."""

    def verify(parts):
        import pyarrow as pa

        for part in parts:
            keep = []
            for left, right in batches(part.column(2), part.column(3)):
                for x, y in zip(shingle_sets(left, k), shingle_sets(right, k), strict=True):
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(SHARE[1] * same >= SHARE[0] * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays(part.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return with_texts(pairs, source, classes).mapInArrow(verify, "a long, b long")


def with_texts(pairs: DataFrame, source: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (a, b, text_a, text_b) of pairs (a, b) of classes.

    Texts of the classes in question are picked out of source and travel to their pairs. A class in very many pairs
    is copied to as many places as it has HEAVY_PIVOT pairs.
    """
    n = 2 * pairs.count()
    ids = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    copies = F.ceil(F.col("n") / HEAVY_PIVOT).cast("int")
    asked = lasting(ids.join(classes, "class").select("class", copies.alias("copies"), F.col("rep").alias("rep"), F.col("row").alias("asked_row")), n)
    same = (F.col("row") == F.col("asked_row")) & F.col("id").eqNullSafe(F.col("rep"))
    texts = source.join(if_few(asked), same).select("class", "copies", "text").dropDuplicates(["class"])
    texts = texts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    heavy = if_few(lasting(asked.where("copies > 1").select("class", "copies"), n // HEAVY_PIVOT))
    other = {"a": "b", "b": "a"}
    for side in ("a", "b"):
        of = heavy.select(F.col("class").alias(side), F.col("copies").alias(f"copies_{side}"))
        salt = F.pmod(F.xxhash64(other[side]), F.coalesce(f"copies_{side}", F.lit(1))).cast("int")
        pairs = pairs.join(of, side, "left").withColumn(f"salt_{side}", salt)
    for side in ("a", "b"):
        mine = texts.select(F.col("class").alias(side), F.col("salt").alias(f"salt_{side}"), F.col("text").alias(f"text_{side}"))
        pairs = pairs.join(mine, [side, f"salt_{side}"])

    return pairs.select("a", "b", "text_a", "text_b")
