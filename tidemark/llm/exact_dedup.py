"""Exact duplicates of whole texts by skew-safe combining, with DataFrame functions only.

Texts are equal when identical after lower-casing A-Z. A first pass over the texts writes (id, SHA-256) and counts the
digests. The texts are then combined in three stages, each of which compares the full text beside the digest: copies
within a task, before anything is shuffled (the partial side of the first aggregate, in the scan's tasks), the survivors of
all tasks within one salt of a digest (its final side), and the winners of a digest's salts (the second aggregate). The
salt of a digest with more than HEAVY rows is the task's number, so such a digest leaves a task as one row and meets in
as many tasks as there are salts; all other digests have a single salt and are whole after the first aggregate, so their
texts travel once and end there.

A document finds its group by the digest alone; only where two different texts had one digest (none is known for
SHA-256), which the rows of a digest and the size of its group tell, the text itself is joined as well.

Cases: a null text counts as empty; empty texts are one group; repeated rows (same doc_id and text) are copies like
any other, each with a row in the result, and all of them are kept where their doc_id is; a null doc_id loses against
any other; an empty table gives no rows; other columns are not looked at. `deduplicate` drops rows, not ids: it leaves
one row of each group, also of rows repeated with their id and of null ids, and a row that shares its id with a copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_BYTES, ascii_lower, lasting, look_up, once, without

SALTS = 16
#: Rows of a digest from which on it is salted, at least; at most one digest in so many rows is.
HEAVY = 1000


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, heavy: int = HEAVY) -> DataFrame:
    """One row per document: id, keep_id (the largest id of its group), group_size, kept, text_sha256."""
    rows = _digested(docs, id_col, text_col)
    digests = lasting(rows.select("id", "sha"))
    again = lasting(digests.groupBy("sha").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    heavy = max(heavy, digests.count() * 80 // BROADCAST_BYTES)  # so that the hot digests, of 80 bytes, fit a broadcast
    hot = F.broadcast(lasting(again.where(F.col("rows") > heavy).select("sha", F.lit(True).alias("hot"))))
    salt = F.when(F.col("hot"), F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(-1)
    combined = (
        rows.join(hot, "sha", "left").withColumn("salt", salt).groupBy("sha", "salt", "norm")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("salt >= 0 OR n > 1")
    )
    combined = lasting(combined.withColumn("norm", F.when(F.col("salt") >= 0, F.col("norm"))))
    whole = combined.where("salt < 0").select("sha", "keep_id", F.col("n").alias("group_size"))
    salted = combined.where("salt >= 0").groupBy("sha", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size")).drop("norm")
    groups = lasting(whole.unionByName(salted))
    clashing = lasting(again.join(groups.groupBy("sha").agg(F.max("group_size").alias("largest")), "sha", "left").where("largest IS NULL OR largest <> rows").select("sha"))
    plain = look_up(digests, groups, "sha", weight=F.lit(96))
    if not clashing.isEmpty():
        apart = rows.join(clashing, "sha", "left_semi")
        known = apart.groupBy("sha", "norm").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        whole = look_up(digests, groups.join(clashing, "sha", "left_anti"), "sha", weight=F.lit(96)).join(clashing, "sha", "left_anti")
        plain = whole.unionByName(apart.join(known, ["sha", "norm"]).select("sha", "id", "keep_id", "group_size"))
    plain = plain.select("id", "sha", F.coalesce("keep_id", "id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    return plain.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Of each group of equal texts one row, all columns: one with the group's keep_id."""
    found = copy_groups(docs, id_col, text_col, salts)
    found = lasting(found.where("group_size > 1").select(F.col(id_col).alias("id"), F.xxhash64(id_col, "text_sha256").alias("row"), "kept"))
    row = F.xxhash64(F.col(id_col), F.sha2(_norm(text_col), 256))
    again = lasting(found.where("kept").groupBy("id", "row").count().where("count > 1").select("id", "row"))
    return once(without(docs, found.where("NOT kept").select("id", "row"), row, id_col), again, row, id_col)


def _norm(text_col: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text_col), F.lit("")))


def _digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), _norm(text_col).alias("norm")).withColumn("sha", F.sha2("norm", 256))
