"""The queries of this subpackage, one per operator, and the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import centroids, decontaminate, exact_dedup, html_text, jaccard_links, language_id, licenses, merkle, packing, quality, secrets, suffix_dedup, url_rules
from tidemark.llm.common import ascii_lower, read


def tokenizer_files() -> dict:
    """Arguments for packing.pack: the installed public byte-level BPE vocabulary."""
    import public_tokenizers

    return {
        "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"),
        "pattern": public_tokenizers.PATTERN,
        "tokenizer_path": public_tokenizers.path("byte_bpe_50k.json"),
        "special": {"<|endoftext|>": 50256},
    }


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.pack(docs, **tokenizer_files())
    return pieces.select("doc_id", "start", "length", F.crc32("token_bytes").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents"))
    spans = F.transform("findings", lambda x: F.concat_ws(":", x["license"], x["start"], x["stop"]))
    return found.select(
        "doc_id", F.size("findings").cast("long").alias("n_findings"), F.array_join(F.array_sort(F.array_distinct("findings.license")), ",").alias("licenses"),
        F.coalesce(F.array_max("findings.coverage"), F.lit(0.0)).alias("coverage"), F.array_join(spans, ",").alias("spans"),
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links.similarity_join(read(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def _crc_part(parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(F.col("id").cast("string")) % parts


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rules = quality.fit(docs, labels, learn=_crc_part(5) != 0)
    scored = quality.score(docs.select(F.col("doc_id").alias("id"), "text"), rules, "id")
    return scored.select(
        F.col("id").alias("doc_id"), (_crc_part(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def language_model(docs: DataFrame) -> language_id.Model | None:
    return language_id.fit(docs, learn=_crc_part(4) != 2)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language_id.predict(docs.select(F.col("doc_id").alias("id"), "text"), language_model(docs), "id")
    return found.select(F.col("id").alias("doc_id"), (_crc_part(4) == 2).alias("held_out"), "lang_pred", "score")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    base = F.filter("spans", lambda x: x["kind"] != "owned")
    live = F.size(F.filter("spans", lambda x: x["verdict"] == "live")).cast("long").alias("n_live")
    return found.select(
        "doc_id", of("assign"), of("access"), of("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), live
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copy_groups(read(spark, sf_dir, "documents"))


#: The rules of op11 as verdict, host and path.
URL_RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
)


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(read(spark, sf_dir, "pages"), URL_RULES).withColumnRenamed("id", "page_id")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeded = F.sha2(F.concat(F.lit("3:"), F.col("id").cast("string")), 256)
    found = centroids.cluster(read(spark, sf_dir, "embeddings"), seeded, k=8, rounds=10, size=64, scale=1024)
    digest = F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256")
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    found = merkle.leaves(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"text": ascii_lower(F.col("text"))}, tampered)
    return merkle.manifest(found).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_licenses": op2_licenses,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_decontamination": op4_decontamination,
    "op5_html_text": op5_html_text,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_quality": op7_quality,
    "op8_language_id": op8_language_id,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_secrets": op10_secrets,
    "op11_url_rules": op11_url_rules,
    "op12_centroids": op12_centroids,
    "op13_merkle": op13_merkle,
}

#: Words of a text as decontamination sees them, in DuckDB.
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLES: dict[str, str] = {
    "op4_decontamination": f"""
        WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
        wins AS (
            SELECT DISTINCT item, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win, least(len(w), 10) AS n
            FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)),
        d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
        grams AS (
            SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
            FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
        hit AS (SELECT r, s, grams.n AS n, item FROM grams JOIN wins USING (win)),
        places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
        items AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
               CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
               sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)""",
    "op9_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
            FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
        FROM d""",
}
