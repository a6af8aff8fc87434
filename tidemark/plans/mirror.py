"""Copies of the archive's files from one root to another, side by side on the executors, that go on where they were cut off.

Roots are what Arrow's file systems open (local and shared folders, HDFS, S3 and the like). A file goes to a name of its own beside its
place and is renamed when its size and, if known, checksum are right, so no half file has a file's name. Each run adds a
line per file to the ledger; what the ledger and the target agree on is not copied again.
"""

from __future__ import annotations

import hashlib
import posixpath
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import inventory

LEDGER = "filename string, status string, size_bytes long, sha256 string, attempts int, error string"
PIECE = 4 << 20


def _store(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def _copied(source, target, name: str, size: int | None, sha: str | None, attempt: str) -> tuple[int, str]:
    """Copies one file and gives its size and checksum; an error if they are not the expected ones."""
    (one, a), (two, b) = source, target
    place = posixpath.join(b, name)
    part = f"{place}.{attempt}.part"
    two.create_dir(posixpath.dirname(place), recursive=True)
    digest, n = hashlib.sha256(), 0
    try:
        with one.open_input_stream(posixpath.join(a, name)) as read, two.open_output_stream(part) as write:
            while piece := read.read(PIECE):
                digest.update(piece)
                n += len(piece)
                write.write(piece)
        if size is not None and n != size:
            raise OSError(f"{n} bytes instead of {size}")
        if sha is not None and digest.hexdigest() != sha:
            raise OSError("another checksum")
        two.move(part, place)
    except BaseException:
        from pyarrow import fs

        if two.get_file_info(part).type != fs.FileType.NotFound:
            two.delete_file(part)
        raise
    return n, digest.hexdigest()


def copy(wanted: DataFrame, source: str, target: str, attempts: int = 3, wait_s: float = 0.5, files_a_task: int = 32) -> DataFrame:
    """A ledger line for each of the wanted files (filename, size_bytes, sha256; the last two may be null); the plan copies them when it runs.

    A file that a task has copied already is copied again if the task is repeated, to the same end.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        stores = _store(source), _store(target)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                error = None
                for k in range(1, attempts + 1):
                    try:
                        n, sha = _copied(*stores, r["filename"], r["size_bytes"], r["sha256"], f"{time.time_ns():x}")
                        out.append((r["filename"], "copied", n, sha, k, None))
                        break
                    except (OSError, pa.ArrowException) as e:
                        error = str(e).splitlines()[0]
                        if k < attempts:
                            time.sleep(wait_s * 2 ** (k - 1))
                else:
                    out.append((r["filename"], "failed", None, None, attempts, error))
            if out:
                kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], ["filename", "status", "size_bytes", "sha256", "attempts", "error"])

    asked = wanted.select("filename", F.col("size_bytes").cast("long").alias("size_bytes"), F.col("sha256").cast("string").alias("sha256")).dropDuplicates(["filename"])
    tasks = max(1, -(-asked.count() // files_a_task))
    return asked.repartition(tasks, "filename").mapInArrow(run, LEDGER)


def listing(spark: SparkSession, root: str, deep: bool = False) -> DataFrame:
    """(filename within the root, size_bytes, sha256 if deep) of the files under a root; parts of files that were cut off are left out."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "filename string, size_bytes long, sha256 string")
    within = F.element_at(F.split("path", f"/{root.rstrip('/').rsplit('/', 1)[-1]}/", 2), 2)
    sha = F.sha2("content", 256) if deep else F.lit(None).cast("string")
    return files.select(within.alias("filename"), F.col("length").alias("size_bytes"), sha.alias("sha256")).where(~F.col("filename").endswith(".part"))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The last line of each file (filename, status, size_bytes, sha256, ...) of a ledger; an absent one has none."""
    try:
        lines = spark.read.schema(LEDGER + ", run long").json(path)
        lines = lines.where("filename IS NOT NULL")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER)
    return inventory.latest(lines, "filename", "run").drop("run")


def mirror(spark: SparkSession, wanted: DataFrame, source: str, target: str, ledger_path: str, **how) -> DataFrame:
    """Copies the wanted files that the target lacks, or has in another size than the ledger says, and gives all their last lines."""
    known = ledger(spark, ledger_path)
    state = inventory.verify(wanted.select("filename").distinct(), listing(spark, target), known.where("status = 'copied'"))
    due = wanted.join(state.where("status <> 'present'").select("filename"), "filename", "left_semi")
    lines = copy(due, source, target, **how).withColumn("run", F.lit(time.time_ns()))
    lines.write.mode("append").json(ledger_path)
    return ledger(spark, ledger_path).join(wanted.select("filename").distinct(), "filename", "left_semi")
