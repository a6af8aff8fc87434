"""The archive's inventory and the state of its processing: listings, ids, candidates, ledgers, mirrors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import LISTED, listing_field, parse_size, stable_id

#: States that need no further work.
DONE = ("complete", "empty")


class CollisionError(ValueError):
    """Two file names share an id."""


def year_folders(pages: DataFrame) -> DataFrame:
    """Year links of an index page (url, html)."""
    return pages.select(F.explode(F.regexp_extract_all("html", F.lit(r'href="(\d{4})/"'), F.lit(1))).alias("year")).distinct()


def listing(pages: DataFrame) -> DataFrame:
    """Inventory records of directory pages (year, url, html): each link to a raster, with the first size of its row."""
    rows = pages.select("year", "url", F.explode(F.split("html", r"(?i)<tr\b[^>]*>|<li\b[^>]*>|\n")).alias("line"))
    linked = rows.withColumn("filename", F.regexp_extract("line", r'href="([^"]+\.tif)"', 1)).where(F.col("filename").rlike(LISTED))
    cells = F.transform(F.split("line", r"(?i)<td\b[^>]*>"), lambda c: parse_size(F.regexp_replace(c, r"<[^>]*>", "")))
    return linked.select(
        stable_id(F.col("filename")).alias("global_id"), listing_field(F.col("filename"), "start").alias("start_date"), listing_field(F.col("filename"), "end").alias("end_date"),
        "year", listing_field(F.col("filename"), "cluster").alias("cluster_id"), "filename", F.concat("url", "filename").alias("download_url"),
        F.try_element_at(F.filter(cells, lambda x: x > 0), F.lit(1)).alias("size_bytes"),
    )


def collisions(inventory: DataFrame) -> DataFrame:
    counted = inventory.groupBy("global_id").agg(F.count_distinct("filename").alias("names"))
    return counted.where("names > 1")


def check_collisions(inventory: DataFrame) -> DataFrame:
    if rows := collisions(inventory).limit(1).collect():
        raise CollisionError(f"two names have the id {rows[0]['global_id']}")
    return inventory


def candidates(inventory: DataFrame, year=None, month: int | None = None, shard: tuple[int, int] | None = None, limit: int | None = None) -> DataFrame:
    """Records of a year, a month of it and a shard (index, count), the first `limit` by id if that is asked for."""
    rows = inventory
    if year is not None:
        rows = rows.where(F.col("year") == str(year))
        if month is not None:
            rows = rows.where(F.col("start_date").startswith(f"{year}-{month:02d}"))
    if shard is not None:
        rows = rows.where(F.col("global_id") % shard[1] == shard[0])
    return rows.orderBy("global_id").limit(limit) if limit is not None else rows


def latest(ledger: DataFrame, key: str = "global_id", order: str = "line") -> DataFrame:
    """The last line of each key, by an aggregate that combines before its shuffle."""
    return ledger.groupBy(key).agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")


def pending(inventory: DataFrame, state: DataFrame) -> DataFrame:
    """Records that are not done yet; state is the latest ledger."""
    return inventory.join(state.where(F.col("process_status").isin(*DONE)).select("global_id"), "global_id", "left_anti")


def failed(inventory: DataFrame, state: DataFrame) -> DataFrame:
    bad = state.where((F.col("download_status") == "failed") | F.col("process_status").isin("failed", "missing_crs"))
    return inventory.join(bad.select("global_id"), "global_id", "left_semi")


def outcomes(state: DataFrame) -> DataFrame:
    """How many records ended how; the counts add up to the number considered."""
    status = F.coalesce("process_status", "download_status", F.lit("pending"))
    return state.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def mirror_plan(inventory: DataFrame, present: DataFrame) -> DataFrame:
    """Files, those there and those to fetch, with the bytes to fetch, in one row."""
    there = inventory.join(present.select("filename").distinct().withColumn("there", F.lit(1)), "filename", "left")
    missing = F.col("there").isNull()
    return there.agg(
        F.count(F.lit(1)).alias("files"), F.count("there").alias("present"), F.count(F.when(missing, 1)).alias("to_download"),
        F.coalesce(F.sum(F.when(missing, F.col("size_bytes"))), F.lit(0)).alias("bytes_to_download"),
    )


def verify(expected: DataFrame, disk: DataFrame, ledger: DataFrame, deep: bool = False) -> DataFrame:
    """present, missing or corrupt for each expected file: its size, and its checksum if deep, against the ledger's.

    disk and ledger have filename, size_bytes and sha256. An empty file, or one that the ledger does not know, is corrupt.
    """
    d = disk.select("filename", F.col("size_bytes").alias("d_size"), F.col("sha256").alias("d_sha"))
    led = ledger.select("filename", F.col("size_bytes").alias("l_size"), F.col("sha256").alias("l_sha"))
    good = (F.col("d_size") > 0) & (F.col("d_size") == F.col("l_size"))
    good = good & (F.col("d_sha") == F.col("l_sha")) if deep else good
    status = F.when(F.col("d_size").isNull(), "missing").when(F.coalesce(good, F.lit(False)), "present").otherwise("corrupt")
    return expected.select("filename").join(d, "filename", "left").join(led, "filename", "left").select("filename", status.alias("status"))


def merge_mirror_ledger(old: DataFrame, new: DataFrame, old_model: str | None = None, new_model: str | None = None) -> DataFrame:
    """File rows of both, the new one where both have a file; a change of the model drops the old ones."""
    if old_model is not None and old_model != new_model:
        return new
    both = old.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)), allowMissingColumns=True)
    newest = F.row_number().over(Window.partitionBy("filename").orderBy(F.desc("age")))
    return both.withColumn("n", newest).where("n = 1").drop("n", "age")


def missing_files(expected: DataFrame, present: DataFrame) -> DataFrame:
    return expected.join(present.select("filename"), "filename", "left_anti")
