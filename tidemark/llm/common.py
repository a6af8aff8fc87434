"""Small Column and session helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.scratch import lasting, release

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. Pure ASCII text takes the fast path, as lower() is the same there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def row_hash(*columns: str) -> Column:
    """A 64-bit key of a row's content; rows that are equal in these columns share it."""
    return F.xxhash64(*[F.col(c) for c in columns])


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that go to a Python worker at once; Spark's own bound is 64 MB, which each of several buffers then holds.
BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, after its session's Arrow batches have been bounded to BATCH_BYTES, unless it has a bound of its own."""
    conf = df.sparkSession.conf
    if str(conf.get(_BATCH, "64m")).lower() in ("64m", "64mb", "67108864", "67108864b"):
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes that may be broadcast (in memory, about twice that); beyond that, joins shuffle.
BROADCAST_BYTES = 8_000_000


def if_few(rows: DataFrame, most: int = BROADCAST_BYTES, weight: Column | None = None) -> DataFrame:
    """rows with a broadcast hint if they have no more than `most` bytes, else as they are.

    weight: the bytes of a row, to be given where columns have no fixed width; by default 8 for each column.
    """
    if weight is None:
        few = rows.limit(most // (8 * len(rows.columns)) + 1).count() <= most // (8 * len(rows.columns))
    else:
        few = (rows.agg(F.sum(weight.cast("long"))).first()[0] or 0) <= most
    return F.broadcast(rows) if few else rows


def free(name: str, *frames: DataFrame) -> str:
    """name, or the next like it that is no column of the frames."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, dropped: DataFrame, row: Column, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id (null is an id, too) and row key are not in dropped (id, key; written already)."""
    gone, key = free("__gone", docs), free("__key", docs)
    return docs.join(if_few(dropped.toDF(gone, key)), _same_row(row, id_col, gone, key), "left_anti")


def once(docs: DataFrame, repeated: DataFrame, row: Column, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs, of those whose id and row key are in repeated (id, key; written already) one each."""
    if repeated.isEmpty():
        return docs
    gone, key = free("__gone", docs), free("__key", docs)
    several = docs.join(if_few(repeated.toDF(gone, key)), _same_row(row, id_col, gone, key), "left_semi").withColumn(key, row)
    return without(docs, repeated, row, id_col).unionByName(several.dropDuplicates([id_col, key]).drop(key))


def _same_row(row: Column, id_col: str, gone: str, key: str) -> Column:
    return F.col(id_col).eqNullSafe(F.col(gone)) & (row == F.col(key))


def look_up(rows: DataFrame, table: DataFrame, key: str, heavy: int = 1000, most: int = BROADCAST_BYTES, weight: Column | None = None) -> DataFrame:
    """rows left joined with table (written already), which has one row per key, on key.

    A table of up to `most` bytes (weight: those of a row) is broadcast. Else keys with more than `heavy` rows are joined apart: there is at most one of
    them in `heavy` rows, so what the table has of these is small beside rows, and is broadcast behind a check.
    """
    small = if_few(table, most, weight)
    if small is not table:
        return rows.join(small, key, "left")
    n = free("__n", rows)
    hot = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > heavy).select(key)
    hot = if_few(lasting(hot))
    return (
        rows.join(hot, key, "left_anti").join(table, key, "left")
        .unionByName(rows.join(hot, key, "left_semi").join(if_few(table.join(hot, key, "left_semi"), weight=weight), key, "left"))
    )


__all__ = ["ascii_lower", "bounded_batches", "if_few", "lasting", "look_up", "once", "read", "release", "row_hash", "without"]
