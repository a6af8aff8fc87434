"""Secret scans with corpus-wide ownership of each candidate.

Base matches are searched in whole texts, leftmost and without overlaps for each kind: assignments of passwords and
tokens, access keys and long hexadecimal strings. Beside them, mixed tokens of TOKEN_LENGTH characters or more are
candidates of the method. Each candidate's value is hashed, and for each hash the distinct repositories and owners
over the corpus are counted. A value that SHARED or more owners hold, or COPIED or more repositories of whatever owners, is a
widely copied example; one that a single owner holds, in fewer repositories, and whose characters look random is a
live-looking credential. Where a table knows no repositories, each different text counts as one. Live-looking mixed tokens that no base match
covers are added as spans of kind `owned`; base spans always stay.

Counting is skew-safe: values are reduced to distinct (value, repository, owner) rows before they meet, so a value
copied into a third of all rows is some rows per task; the counts come back by a join on rows of a few bytes, salted.

Cases: a null text counts as empty and has no spans; a null repository or owner counts as the empty one; repeated rows each
get a row in the result and count as one owner; a null id is kept; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, lasting

KINDS = ["assign", "access", "hex", "owned"]
TOKEN_LENGTH = 20
ENTROPY = 3.6
SHARED, COPIED = 3, 8
SALTS = 16

# The base patterns, each with the least length of what it must match.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32
KEYWORDS = ("passw", "secret", "token", "api")

_SPAN = "kind string, start int, stop int, value long, random boolean"


def _patterns() -> dict[str, re.Pattern]:
    return {
        "assign": re.compile(ASSIGN, re.IGNORECASE | re.ASCII),
        "access": re.compile(ACCESS),
        "hex": re.compile(HEX.replace("+", f"{{{HEX_LENGTH},}}")),  # runs are taken whole, so the length can be asked for at once
        "long": re.compile(rf"[A-Za-z0-9+/_-]{{{TOKEN_LENGTH},}}"),
    }


def candidates(text: str, patterns: dict[str, re.Pattern]) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the base matches of a text and of its mixed tokens (kind owned) outside of them."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        for m in patterns["assign"].finditer(text):
            if len(m[2]) >= ASSIGN_LENGTH:
                found.append(("assign", *m.span(), m[2]))
    if "AKIA" in text:
        for m in patterns["access"].finditer(text):
            if len(m[0]) >= ACCESS_LENGTH:
                found.append(("access", *m.span(), m[0]))
    longs = list(patterns["long"].finditer(text))
    if any(len(m[0]) >= HEX_LENGTH for m in longs):
        found += [("hex", *m.span(), m[0]) for m in patterns["hex"].finditer(text)]
    covered, at = _merged((a, b) for _, a, b, _ in found), 0
    for m in longs:
        while at < len(covered) and covered[at][1] <= m.start():
            at += 1
        free = at == len(covered) or m.end() <= covered[at][0]
        if free and re.search(r"\d", m[0]) and re.search("[A-Za-z]", m[0]):
            found.append(("owned", *m.span(), m[0]))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _merged(spans) -> list[tuple[int, int]]:
    """Sorted spans, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def looks_random(value: str) -> bool:
    """Whether the characters' entropy, against the most that the length allows, is that of a generated string."""
    counts = Counter(value)
    bits = -sum(n / len(value) * log2(n / len(value)) for n in counts.values())
    return bits >= min(ENTROPY, 0.8 * log2(len(value)) if len(value) > 1 else 1)


def _found(parts):
    import pyarrow as pa

    patterns = _patterns()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.int64()), ("random", pa.bool_())]))
    for part in parts:
        spans = []
        for text in part.column(3):
            spans.append([
                {"kind": k, "start": a, "stop": b, "value": int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little", signed=True), "random": looks_random(v)}
                for k, a, b, v in candidates(text.as_py() or "", patterns)
            ])
        yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), part.column(2), pa.array(spans, kind)], names=["id", "repository", "owner", "spans"])


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None, owner: Column | None = None,
    shared: int = SHARED, copied: int = COPIED, salts: int = SALTS,
) -> DataFrame:
    """One row per document: id, spans (kind, start, stop, value, random, owners, verdict), sorted by start.

    Base spans have the verdict `example` (`shared` owners or `copied` repositories, or more), `live` (one owner, random) or
    `unclear`; of the mixed tokens only live ones are there. Without `owner` that is the column source, and without
    `repository` a hash of the text.
    """
    repository = F.xxhash64(text_col) if repository is None else repository
    owner = F.col("source") if owner is None else owner
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), repository.cast("string").alias("repository"), owner.cast("string").alias("owner"), F.col(text_col).alias("text"))
    found = lasting(rows.mapInArrow(_found, f"id long, repository string, owner string, spans array<struct<{_SPAN.replace(' ', ':').replace(',:', ', ')}>>"))
    held = found.select("repository", "owner", F.explode("spans.value").alias("value")).distinct()
    owned = held.groupBy("value").agg(
        F.count_distinct(F.coalesce("owner", F.lit(""))).alias("owners"), F.count_distinct(F.coalesce("repository", F.lit(""))).alias("repositories")
    )
    uid = F.xxhash64("id", "spans")
    each = found.where("size(spans) > 0").select("id", uid.alias("uid"), F.explode("spans").alias("s")).distinct()
    each = each.withColumn("value", F.col("s.value")).withColumn("salt", F.pmod("uid", F.lit(salts)).cast("int"))
    owned = owned.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    verdict = F.when((F.col("owners") >= shared) | (F.col("repositories") >= copied), "example").when((F.col("owners") == 1) & F.col("s.random"), "live").otherwise("unclear")
    judged = each.join(owned, ["value", "salt"]).select("id", "uid", "s.*", "owners", verdict.alias("verdict"))
    judged = judged.where("kind <> 'owned' OR verdict = 'live'").withColumn("place", _place())
    by_row = judged.groupBy("id", "uid").agg(F.sort_array(F.collect_list(F.struct("start", "place", "kind", "stop", "value", "random", "owners", "verdict"))).alias("judged"))
    by_row = by_row.select(F.col("id").alias("i"), "uid", "judged")
    base = found.select("id", uid.alias("u"))
    out = base.join(by_row, (F.col("u") == F.col("uid")) & F.col("id").eqNullSafe(F.col("i")), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("judged", F.array().cast(by_row.schema["judged"].dataType)).alias("spans"))


def _place() -> Column:
    out = F.lit(len(KINDS))
    for k, kind in enumerate(KINDS):
        out = F.when(F.col("kind") == kind, F.lit(k)).otherwise(out)
    return out
