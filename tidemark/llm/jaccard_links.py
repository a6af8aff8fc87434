"""The answers of the Jaccard self-join: how many documents each one is linked with, without emitting all pairs.

Links never leave a component, so answers are derived there from those of one set, by relations between sets. Each
component has a reference set Y: one of its sets first, with which all others are compared once, which gives their
differences; then Y takes or drops the shingles that more than half of the sets have or lack against it. Let a set X lack
r(X) shingles of Y. Two sets X and Z of n and m shingles that share s differences (both lack, or both have beside Y) share
|Y| - r(X) - r(Z) + s shingles, so with a weight w(X) = 2p n + 2(p+q) r(X) - (p+q)|Y| they are linked at p/q if and only if
w(X) + w(Z) <= 2(p+q) s. What is linked whatever s is, is a range of the component's list of weights: each set takes its
answers from there by a running sum over the distinct weights, as Y's own are. Sets of equal weight and with the same
differences, but for those that no other set has, are of one kind and have the same answers. Only kinds that share a
difference, and are far enough from Y that weights alone do not link them, are met in lists of differences, block by block.
There a pair is a candidate only if it can share the ceil((w(X) + w(Z)) / 2(p+q)) differences that it needs: by what both
have from the list's difference on, rare ones first, and by signatures of SIGNATURE words, which bound what both have in
all. Candidates are verified on the full lists.

So near copies of one text cost a comparison and a look-up each, however many there are, and a pair of kinds is looked at
only where both are far from Y. That, too, is exact: no pair is dropped. Candidates are about the links between such
kinds, which are listed; their number can grow with the square of a group of kinds that are all far from Y.

Cases: as in jaccard_join. Documents with equal sets are linked with each other and have the same class_id, the least id
among them (null if all are null); without shingles a document is a class of its own with no links.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import if_few, lasting, look_up, release
from tidemark.llm.jaccard_join import SHARE, K, labelled, source_rows, with_texts
from tidemark.llm.shingles import batches, shingle_sets

#: Sets of a block of a list of differences.
BLOCK = 1000
#: 64-bit words of a signature of a set's differences.
SIGNATURE = 4


def similarity_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable by links, its own included), class_id
    (the smallest id with an equal set) and n_links (the other documents that it is linked with)."""
    rows, of_class = labelled(docs, id_col, text_col, k)
    links = link_counts(rows, of_class, source_rows(docs, id_col, text_col), k)
    found = look_up(rows, links.select("class", "rep", "component_id", "n_links"), "class")
    of = lambda c: F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col(c))
    return found.select(F.col("id").alias(id_col), "n_shingles", of("component_id").alias("component_id"), of("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def link_counts(rows: DataFrame, of_class: DataFrame, source: DataFrame, k: int = K) -> DataFrame:
    """Rows (class, rep, component_id, n_links) of all classes that jaccard_join.labelled gives."""
    count = of_class.count()
    sizes = rows.where("class IS NOT NULL").groupBy("class").agg(F.count(F.lit(1)).alias("size"), F.max("n_shingles").alias("n"))
    sets = lasting(of_class.join(sizes, "class"), count)
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "row", "class", "n")).alias("first")
    groups = sets.groupBy("label").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("total"), first)
    groups = lasting(groups.where("members > 1").select("label", "members", "total", F.col("first.class").alias("ref"), F.col("first.n").alias("ref_n")), count)
    sets = lasting(look_up(sets, groups, "label"), count)

    pairs = sets.where("members > 2 AND class <> ref").select(F.col("class").alias("a"), F.col("ref").alias("b"))
    apart = differences(lasting(pairs, count), source, of_class.select("class", "rep", "row"), k)
    several = sets.where("members > 2").select("class", "ref", "ref_n", "members", "n", "size")
    held, ref_sizes = lasting(several, count), groups.where("members > 2").select("ref", "ref_n")
    apart, ref_sizes = by_majority(apart, held, ref_sizes, count)
    more = derived(apart, held.drop("ref_n"), ref_sizes, count)

    all_ = sets.join(more, "class", "left")
    n_links = F.when(F.col("members").isNull(), F.lit(0)).when(F.col("members") == 2, F.col("total") - F.col("size")).otherwise(F.col("others"))
    found = lasting(all_.select("class", "rep", "component_id", (n_links + F.col("size") - 1).alias("n_links")), count)
    release(sets, groups, held, apart)
    return found


def differences(pairs: DataFrame, source: DataFrame, classes: DataFrame, k: int = K) -> DataFrame:
    """Rows (class, ref, token, lacks) for pairs (a: class, b: ref): the shingles that one of the two sets has and the other
    has not; lacks where it is the class that has it not."""

    def compare(parts):
        import pyarrow as pa

        for part in parts:
            at = 0
            for left, right in batches(part.column(2), part.column(3)):
                tokens, lacks, length = [], [], []
                for x, y in zip(shingle_sets(left, k), shingle_sets(right, k), strict=True):
                    less, more = np.setdiff1d(y, x, assume_unique=True), np.setdiff1d(x, y, assume_unique=True)
                    tokens += [less, more]
                    lacks += [np.ones(len(less), dtype=bool), np.zeros(len(more), dtype=bool)]
                    length.append(len(less) + len(more))
                of = [pa.array(np.repeat(part.column(c).slice(at, len(length)).to_numpy(zero_copy_only=False), length)) for c in (0, 1)]
                at += len(length)
                yield pa.RecordBatch.from_arrays([*of, pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(lacks))], names=["class", "ref", "token", "lacks"])

    return lasting(with_texts(pairs, source, classes).mapInArrow(compare, "class long, ref long, token long, lacks boolean"))


def by_majority(apart: DataFrame, sets: DataFrame, ref_sizes: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """The differences from references, and their sizes (ref, ref_n), after a shingle by which more than half of the sets
    differ has changed sides.

    What a reference takes or drops is an array: it is less than twice the mean number of differences of its sets.
    """
    lists = apart.groupBy("ref", "token", "lacks").agg(F.count(F.lit(1)).alias("n"))
    turned = lists.join(sets.groupBy("ref").agg(F.max("members").alias("members")), "ref").where("2 * n > members").select("ref", "token", "lacks")
    turned = lasting(turned)
    arrays = lasting(turned.groupBy("ref").agg(F.collect_list(F.struct("token", "lacks")).alias("turned")), count)
    weight = 16 + 17 * F.size("turned")
    given = look_up(sets.select("class", "ref"), arrays, "ref", weight=weight).where("turned IS NOT NULL")
    given = given.select("class", "ref", F.explode("turned").alias("x")).select("class", "ref", "x.token", (~F.col("x.lacks")).alias("lacks"))
    stays = apart.join(if_few(turned.select("ref", "token")), ["ref", "token"], "left_anti").select("class", "ref", "token", "lacks")
    taken = given.join(apart.select("class", "token"), ["class", "token"], "left_anti").select("class", "ref", "token", "lacks")
    change = F.aggregate("turned", F.lit(0).cast("long"), lambda n, x: n + F.when(x["lacks"], -1).otherwise(1))
    sizes = ref_sizes.join(arrays, "ref", "left").select("ref", (F.col("ref_n") + F.coalesce(change, F.lit(0))).alias("ref_n"))
    out = lasting(stays.unionByName(taken)), lasting(sizes, count)
    release(turned, arrays)
    return out


def derived(apart: DataFrame, sets: DataFrame, ref_sizes: DataFrame, count: int) -> DataFrame:
    """Rows (class, others): the documents of other classes that each class is linked with."""
    p, q = SHARE
    lacking = apart.where("lacks").groupBy("class").agg(F.count(F.lit(1)).alias("r"))
    w = 2 * p * F.col("n") + 2 * (p + q) * F.coalesce("r", F.lit(0)) - (p + q) * F.col("ref_n")
    weighed = look_up(sets, ref_sizes, "ref").join(lacking, "class", "left")
    weighed = lasting(weighed.select("class", "size", F.struct("ref", w.cast("long").alias("w")).alias("at")), count)

    of_weight = lasting(weighed.groupBy("at").agg(F.sum("size").alias("size")).select("at", "size"), count)
    asked = of_weight.select("at.ref", (-F.col("at.w")).alias("upto"), F.lit(0).cast("long").alias("size"), "at")
    given = of_weight.select("at.ref", F.col("at.w").alias("upto"), "size", F.lit(None).cast("struct<ref: long, w: long>").alias("at"))
    upto = Window.partitionBy("ref").orderBy("upto").rangeBetween(Window.unboundedPreceding, 0)
    near = given.unionByName(asked).withColumn("near", F.sum("size").over(upto)).where("at IS NOT NULL")
    near = lasting(near.select("at", "near"), count)
    own = F.when(F.col("at.w") <= 0, F.col("size")).otherwise(0)
    found = look_up(weighed, near, "at", weight=F.lit(32)).select("class", (F.col("near") - own).alias("others"))

    alike = kinds(apart, weighed, count)
    far = beyond(apart, alike, of_weight, count)
    out = lasting(found.unionByName(far).groupBy("class").agg(F.sum("others").alias("others")), count)
    release(weighed, of_weight, near, alike)
    return out


def kinds(apart: DataFrame, weighed: DataFrame, count: int) -> DataFrame:
    """Rows (class, size, ref, w, kind, s, first, total) of all sets: those of one component, of equal weight and with the same
    differences among the s that some other set has, too, are of one kind, and have the same answers outside of it.

    first is the least class of the kind, total the documents of all its classes.
    """
    shared = apart.groupBy("ref", "token").agg(F.min("class").alias("one"), F.max("class").alias("two")).where("one < two").select("ref", "token")
    mine = apart.join(shared, ["ref", "token"]).groupBy("class").agg(
        F.count(F.lit(1)).alias("s"), F.sum(F.xxhash64("token").cast("decimal(38,0)")).alias("one"), F.bit_xor(F.xxhash64(F.lit(7), "token")).alias("two"),
    )
    sets = weighed.select("class", "size", "at.ref", "at.w").join(mine, "class", "left")
    sets = sets.select("class", "size", F.struct("ref", "w", F.coalesce("s", F.lit(0)).alias("s"), "one", "two").alias("key"))
    sets = lasting(sets.select("class", "size", "key.ref", "key.w", "key.s", F.xxhash64("key").alias("kind"), F.xxhash64(F.lit(7), "key").alias("other")), count)
    of_kind = sets.groupBy("kind", "other").agg(F.min("class").alias("first"), F.sum("size").alias("total"))
    of_kind = lasting(of_kind.select(F.struct("kind", "other").alias("of"), "first", "total"), count)
    found = look_up(sets.select("class", "size", "ref", "w", "s", F.struct("kind", "other").alias("of")), of_kind, "of", weight=F.lit(40))
    return lasting(found.drop("of"), count)


def beyond(apart: DataFrame, alike: DataFrame, of_weight: DataFrame, count: int) -> DataFrame:
    """Rows (class, others) for links that weights alone do not give: pairs with w(X) + w(Z) > 0 and enough shared differences.

    Kinds of sets are met, each by its first class.
    """
    enough = 2 * sum(SHARE)
    farthest = lasting(of_weight.groupBy("at.ref").agg(F.max("at.w").alias("most")), count)
    firsts = look_up(alike.where("class = first"), farthest, "ref").where("w + most > 0").select("class", "w")
    lists = lasting(look_up(apart.select("class", F.struct("ref", "token").alias("key")), lasting(firsts, count), "class").where("w IS NOT NULL"))
    far = lasting(signed(lists))
    pairs = met = lasting(candidates(far).distinct())
    tokens = far.select("class", "keys.token")
    for side in ("a", "b"):
        pairs = look_up(pairs, tokens.toDF(side, f"of_{side}"), side, weight=F.expr(f"24 + 8 * size(of_{side})"))
    links = lasting(pairs.where(F.col("w") <= enough * F.size(F.array_intersect("of_a", "of_b"))).select("a", "b"))
    ends = links.select(F.col("a").alias("first"), F.col("b").alias("class")).unionByName(links.select(F.col("b").alias("first"), F.col("a").alias("class")))
    totals = lasting(alike.where("class = first").select("class", "total"), count)
    outside = lasting(look_up(ends, totals, "class").groupBy("first").agg(F.sum("total").alias("outside")), count)
    inside = F.when((F.col("w") > 0) & (2 * F.col("w") <= enough * F.col("s")), F.col("total") - F.col("size")).otherwise(0)
    release(lists, far, met, links)
    return look_up(alike, outside, "first").select("class", (F.coalesce("outside", F.lit(0)) + inside).alias("others"))


def signed(lists: DataFrame) -> DataFrame:
    """Rows (class, w, ref, keys, s0, s1, ...) of the lists (class, key: ref and token, w): for each class its differences that
    some other class has, too, as an array (n, token) from rare to common, and the words of their signature."""
    lengths = lasting(lists.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = look_up(lists, lengths, "key", weight=F.lit(24)).where("n IS NOT NULL")
    shared = shared.withColumn("at", F.pmod(F.xxhash64("key.token"), F.lit(64 * SIGNATURE)).cast("int"))
    bit = F.expr("shiftleft(1L, at % 64)")
    words = [F.bit_or(F.when(F.expr(f"at div 64 = {i}"), bit).otherwise(0)).alias(f"s{i}") for i in range(SIGNATURE)]
    keys = F.sort_array(F.collect_list(F.struct("n", "key.token"))).alias("keys")
    return shared.groupBy("class").agg(F.max("w").alias("w"), F.max("key.ref").alias("ref"), keys, *words)


def candidates(far: DataFrame) -> DataFrame:
    """Rows (a, b, w) of pairs of classes of one component whose sum w of weights is above 0 and that may share enough
    differences, at least once each.

    The first difference that two sets share has all the others behind it in both arrays, so pairs are met where these are
    long enough. A list of differences goes into blocks, each of which meets each other one in one place.
    """
    enough = 2 * sum(SHARE)
    words = [f"s{i}" for i in range(SIGNATURE)]
    dealt = far.select("class", "w", "ref", *words, F.size("keys").alias("have"), F.posexplode("keys").alias("pos", "x"))
    dealt = dealt.select(
        F.struct("ref", "x.token").alias("key"), "class", "w", *words, "have", (F.col("have") - F.col("pos")).alias("left"), F.ceil(F.col("x.n") / BLOCK).cast("int").alias("blocks")
    ).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))

    def side(low: Column, high: Column, name: str) -> DataFrame:
        kept = [F.col(c).alias(f"{c}_{name}") for c in ("w", "have", "left", *words)]
        places = dealt.select("key", F.col("class").alias(name), *kept, "block", F.explode(F.sequence(low, high)).alias("met"))
        mine = [F.col("block"), F.col("met")] if name == "x" else [F.col("met"), F.col("block")]
        return places.withColumns({"low": mine[0], "high": mine[1]}).drop("block", "met")

    def most(name: str, other: str) -> Column:
        """What the set `name` has and the other may have: its bits that the other lacks are one difference each, at least."""
        return F.col(f"have_{name}") - sum(F.bit_count(F.col(f"{c}_{name}").bitwiseAND(F.bitwise_not(f"{c}_{other}"))) for c in words)

    x, z = side(F.col("block"), F.col("blocks") - 1, "x"), side(F.lit(0), F.col("block"), "z")
    both = x.join(z, ["key", "low", "high"]).where("w_x + w_z > 0 AND (low < high OR x < z)")
    w = F.col("w_x") + F.col("w_z")
    both = both.where(w <= enough * F.least("left_x", "left_z")).where(w <= enough * F.least(most("x", "z"), most("z", "x")))
    return both.select(F.least("x", "z").alias("a"), F.greatest("x", "z").alias("b"), w.alias("w"))
