"""Statistical regions: search by code or name, with accents, variants, exonyms and close misspellings."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import EXONYMS, GEOCODE_CUTOFF, SEARCH_CUTOFF, SUGGEST_CUTOFF, fold, name_variants, nuts_level, similarity


def complete_columns(rows: DataFrame) -> DataFrame:
    """Level, country and names derived where they are not given; regions without territory are dropped."""
    level = F.coalesce(F.col("LEVL_CODE").cast("int"), nuts_level(F.col("NUTS_ID")))
    out = rows.withColumn("LEVL_CODE", level).withColumn("CNTR_CODE", F.coalesce("CNTR_CODE", F.substring("NUTS_ID", 1, 2)))
    out = out.withColumn("NAME_LATN", F.coalesce("NAME_LATN", "NUTS_NAME", "NUTS_ID")).withColumn("NUTS_NAME", F.coalesce("NUTS_NAME", "NAME_LATN"))
    return out.where(~F.col("NUTS_ID").rlike("^..Z+$"))


def variants(table: DataFrame) -> DataFrame:
    """The lookup keys of every region: (key, NUTS_ID)."""
    both = table.select("NUTS_ID", F.explode(F.array_union(name_variants(F.col("NAME_LATN")), name_variants(F.col("NUTS_NAME")))).alias("name"))
    return both.select(fold("name").alias("key"), "NUTS_ID").where("key <> ''").distinct()


def search(table: DataFrame, query: str | None = None, level: int | None = None, country: str | None = None) -> DataFrame:
    """Regions by code (with all below it) or by name, ordered by code."""
    rows = table
    if query is not None:
        text = query.strip()
        if re.fullmatch(r"[A-Z]{2}[A-Z0-9]{0,3}", text.upper()) and not table.where(F.col("NUTS_ID") == text.upper()).isEmpty():
            rows = rows.where(F.col("NUTS_ID").startswith(text.upper()))
        else:
            rows = rows.join(_by_name(table, text), "NUTS_ID", "left_semi")
    if level is not None:
        rows = rows.where(F.col("LEVL_CODE") == level)
    if country is not None:
        rows = rows.where(F.col("CNTR_CODE") == country.strip().upper())
    return rows.orderBy("NUTS_ID")


def _folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).strip().lower()


def _by_name(table: DataFrame, text: str) -> DataFrame:
    target = _folded(text.split(",")[0])
    index = variants(table)
    keys = [k for k in (target, EXONYMS.get(target)) if k]
    found = index.where(F.col("key").isin(keys)).select("NUTS_ID")
    if len(target) >= 3:
        held = table.where(fold("NAME_LATN").contains(target) | fold("NUTS_NAME").contains(target))
        found = found.union(held.select("NUTS_ID"))
    if found.isEmpty():
        # The ten closest keys are the feature.
        scored = index.groupBy("key").agg(F.first("key").alias("k")).withColumn("s", similarity(F.col("key"), target)).where(F.col("s") >= SEARCH_CUTOFF)
        close = scored.orderBy(F.desc("s"), F.desc("key")).limit(10).select("key")
        found = index.join(F.broadcast(close), "key", "left_semi").select("NUTS_ID")
    return found.distinct()


class PlaceError(ValueError):
    """No region has the name or the code; the message holds close ones."""


def _close(keys: DataFrame, target: str, cutoff: float, n: int) -> list[str]:
    scored = keys.distinct().withColumn("s", similarity(F.col("key"), target)).where(F.col("s") >= cutoff)
    return [r.key for r in scored.orderBy(F.desc("s"), F.desc("key")).limit(n).collect()]  # the n closest are the feature


def geocode(table: DataFrame, name: str, level: int | None = None) -> DataFrame:
    """The regions that a place's name stands for: by its key, else by its exonym, else by the one closest key."""
    target = _folded(name.split(",")[0])
    index = variants(table)
    keys = [k for k in (target, EXONYMS.get(target)) if k]
    there = {r.key for r in index.where(F.col("key").isin(keys)).select("key").distinct().collect()}
    found = next((k for k in keys if k in there), None)
    if found is None:
        found = next(iter(_close(index.select("key"), target, GEOCODE_CUTOFF, 1)), None)
    rows = table.join(index.where(F.col("key") == found).select("NUTS_ID"), "NUTS_ID", "left_semi")
    rows = rows if level is None else rows.where(F.col("LEVL_CODE") == level)
    if found is None or rows.isEmpty():
        raise PlaceError(f"no region {name!r}; close ones: {sorted(_close(index.select('key'), target, SUGGEST_CUTOFF, 5))}")
    return rows


def by_code(table: DataFrame, codes: str | Sequence[str]) -> DataFrame:
    """The regions with these codes, each once; an error names the codes that there are not."""
    asked = sorted({c.strip().upper() for c in ([codes] if isinstance(codes, str) else codes)})
    rows = table.where(F.col("NUTS_ID").isin(asked)).dropDuplicates(["NUTS_ID"])
    there = {r.NUTS_ID for r in rows.select("NUTS_ID").collect()}
    if not asked:
        raise PlaceError("no code is given")
    if lacking := [c for c in asked if c not in there]:
        raise PlaceError(f"no region {lacking}; close to the first: {_close(table.select(F.col('NUTS_ID').alias('key')), lacking[0], SUGGEST_CUTOFF, 5)}")
    return rows


def with_geometry(rows: DataFrame, geometries: DataFrame) -> DataFrame:
    return rows.join(geometries, "NUTS_ID", "left")
