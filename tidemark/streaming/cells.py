"""New cell files as a stream: each cell of an event once, however often its file is delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.lake import build_cells
from tidemark.sources.tables import LAKE


def read_cells(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(LAKE).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(path)


def new_cells(cells: DataFrame) -> DataFrame:
    """The state holds each (col, row, flood_id) that was seen; the lake grows by its distinct cells only."""
    return cells.dropDuplicates(["col", "row", "flood_id"])


def append_lake(cells: DataFrame, path: str, checkpoint: str):
    """Appends new cells exactly once; restarting with the same checkpoint goes on where it stopped."""
    return new_cells(cells).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def refresh_cells(cells: DataFrame, write, checkpoint: str, lake=None):
    """Calls write(changed cells with all their events) for every batch of the stream.

    lake gives the cells that were known before (a function, as they change from batch to batch); without it a batch stands alone.
    """

    def changed(batch, _):
        rows = batch.select("col", "row", "flood_id")
        if lake is not None:
            known = lake().select("col", "row", "flood_id").join(rows.select("col", "row").distinct(), ["col", "row"], "left_semi")
            rows = rows.unionByName(known)
        write(build_cells(rows))

    return cells.writeStream.option("checkpointLocation", checkpoint).foreachBatch(changed).trigger(availableNow=True).start()
