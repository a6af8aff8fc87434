"""Null ids, very long texts, ties, repeated rows, empty tables and further columns with the operators' own names, for each of them."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontaminate, exact_dedup, html_text, jaccard_join, licenses, packing, secrets, suffix_dedup
from tidemark.llm import queries as Q
from tidemark.llm.common import once, without

FURTHER = ["id", "sha", "key", "class", "row", "norm", "salt", "label", "n", "__gone", "__key", "__n", "words", "spans", "html_"]


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def rows():
    r = random.Random(3)
    prose = " ".join("".join(r.choice("aeioustrn") for _ in range(r.randint(2, 8))) for _ in range(300))
    return [
        (1, prose, "en"), (1, prose, "en"), (None, prose.upper(), "en"), (2, prose + " more", "de"), (None, None, None), (3, None, "fr"), (4, "", "en"), (5, " " * 200_000 + "x", "en"),
        (6, "ab " * 60_000, "de"), (7, "".join(r.choice("abcdefghij") for _ in range(200_000)), None), (8, "é漢" * 50_000, "fr"), (9, prose[:900], "es"), (10, "A. B. " * 20_000, "en"),
    ]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of documents, labels and the rest, with columns that clash, and one of empty tables."""
    out = {}
    for name, found in (("odd", rows()), ("none", [])):
        path = tmp_path_factory.mktemp(name)
        docs = spark.createDataFrame([(i, t, lang, "s", None) for i, t, lang in found], "doc_id long, text string, lang string, source string, n_chars long")
        docs.withColumns({c: F.lit(7) for c in FURTHER}).repartition(3).write.parquet(str(path / "documents.parquet"))
        labels = spark.createDataFrame([(i, i % 2, 0) for i in (1, 2, 6, 7, 8, 9, 10)] if found else [], "doc_id long, quality long, toxic long")
        labels.withColumn("id", F.lit(1)).withColumn("y", F.lit(1)).write.parquet(str(path / "labels.parquet"))
        spark.createDataFrame([(1, " ".join(rows()[0][1].split()[:12])), (2, None), (3, "")] if found else [], "item_id long, text string").withColumn("key", F.lit(1)).write.parquet(str(path / "benchmark.parquet"))
        page = [(1, "http://a.net/es/1", "<p>A text of some words, that says something.</p>"), (1, "http://a.net/es/1", "<p>A text of some words, that says something.</p>"), (None, None, None), (2, "x", "<div>" * 30_000 + "deep" + "<svg>" * 30_000)]
        spark.createDataFrame(page if found else [], "page_id long, url string, html string").withColumns({c: F.lit(7) for c in ("id", "row", "label", "tokens", "path")}).write.parquet(str(path / "pages.parquet"))
        vectors = [(i % 5, [float((i * k) % 7) for k in range(64)]) for i in range(12)] + [(None, [1.0] * 64)]
        spark.createDataFrame(vectors if found else [], "vec_id long, embedding array<float>").withColumns({c: F.lit(7) for c in ("id", "cluster", "vector")}).write.parquet(str(path / "embeddings.parquet"))
        out[name] = str(path)
    return out


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_each_row_has_its_row(spark, tables, name):
    found = Q.QUERIES[name](spark, tables["odd"]).collect()
    key = "page_id" if name in ("op5_html_text", "op11_url_rules") else "vec_id" if name == "op12_centroids" else "doc_id"
    want = [1, 1, 2, None] if key == "page_id" else [*[i % 5 for i in range(12)], None] if key == "vec_id" else [i for i, _, _ in rows()]
    ids = [r[key] for r in found]
    order = lambda xs: sorted(xs, key=lambda v: (v is None, v or 0))
    if name == "op1_packing":
        assert order(set(ids)) == order(set(want))
    else:
        assert order(ids) == order(want)
    assert Q.QUERIES[name](spark, tables["none"]).count() == 0


def test_results_on_long_and_repeated_texts(spark, tables):
    docs = spark.read.parquet(f"{tables['odd']}/documents.parquet")
    texts = {i: t for i, t, _ in rows() if i is not None}
    groups = {}
    for i, t, _ in rows():
        groups.setdefault(lower(t), []).append(i)
    for r in exact_dedup.copy_groups(docs).collect():
        if r.doc_id is not None:
            g = groups[lower(texts[r.doc_id])]
            assert (r.group_size, r.text_sha256) == (len(g), hashlib.sha256(lower(texts[r.doc_id]).encode()).hexdigest())
    words = {r.doc_id: r.n_words for r in decontaminate.contamination(docs, spark.read.parquet(f"{tables['odd']}/benchmark.parquet")).collect()}
    assert all(words[i] == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))) for i, t in texts.items())
    ids = {}
    for r in packing.pack(docs.where("doc_id > 3"), **Q.tokenizer_files()).collect():
        ids[r.doc_id] = ids.get(r.doc_id, 0) + r.length
        assert r.doc_tokens >= r.length
    assert set(ids) == {4, 5, 6, 7, 8, 9, 10} and ids[4] == 1
    removed = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert removed[6].n_bytes == 180_000 and not removed[6].kept and removed[7].kept == texts[7].encode()  # pairs over and over, letters at random
    near = {r.doc_id: r for r in jaccard_join.near_duplicates(docs).collect()}
    assert near[2].component_id == 1 and near[6].n_shingles == 1 and near[7].n_shingles == 1 and near[4].n_shingles == 0
    assert all(not r.spans for r in secrets.scan(docs).collect())
    assert all(not r.findings for r in licenses.scan(docs).collect())
    pages = {r.page_id: r.text for r in html_text.extract(spark.read.parquet(f"{tables['odd']}/pages.parquet")).collect()}
    assert pages[1] == "A text of some words, that says something." and pages[None] == ""


def test_the_pipeline_on_odd_rows_and_on_none(spark, tables):
    docs = spark.read.parquet(f"{tables['odd']}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, tables["odd"])
        assert after.columns == docs.columns
        docs = after
    assert corpus_pipeline.run(spark, tables["none"]).count() == 0
    assert corpus_pipeline.run(spark, tables["odd"]).where("doc_id = 7").agg(F.sum("length")).first()[0] > 0


def test_rows_go_by_id_and_key_beside_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (2, "c"), (2, "c")], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("__gone", "__key", "__GONE_")})
    row = F.xxhash64("doc_id", "text")
    gone = docs.where("text = 'a'").select("doc_id", row.alias("key"))
    kept = without(docs, gone, row)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "b"), (2, "c"), (2, "c")]
    again = docs.where("doc_id = 2").select("doc_id", row.alias("key")).distinct()
    assert sorted((r.doc_id or 0, r.text) for r in once(docs, again, row).collect()) == [(0, "a"), (1, "a"), (1, "b"), (2, "c")]
