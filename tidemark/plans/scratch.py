"""Intermediate tables that cut the lineage: Parquet files in a folder which all executors share.

A checkpointed frame keeps the planner's estimate of its size, which every join multiplies; over the rounds of a loop the
estimate itself grows without bound. Files have a real size, hold compressed columns, and survive lost executors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PATH = "_scratch_path"
#: Files of a small table, rows of a file where their number is bounded, and rows of a task where a table is dealt by its size.
LEAST_FILES, FILE_ROWS, TASK_ROWS = 8, 50_000, 250_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session without one, as in tests, gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='scratch-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/tidemark-{spark.sparkContext.applicationId}"
    where, system = _hadoop(spark, path)
    system.mkdirs(where)
    system.deleteOnExit(where)
    return path


def lasting(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df written to this application's folder and read back.

    rows: a bound on the number of rows, where one is known; a small table then goes into a few files, however many
    partitions a shuffle has.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _PATH, path)
    return out


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df shuffled by some columns into as many partitions as a bound on its rows asks for, so that what a task sorts or
    gathers stays as it is when tables grow. Windows and aggregates by more columns than these stay where the rows are."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *by)


def release(*frames: DataFrame) -> None:
    """Deletes the files of lasting frames that no plan reads any more."""
    for df in frames:
        if path := getattr(df, _PATH, None):
            where, system = _hadoop(df.sparkSession, path)
            system.delete(where, True)


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())
