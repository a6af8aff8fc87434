import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages(spark):
    import corpus_pipeline as P
    from tidemark.llm.common import lasting
    from tidemark.llm.queries import op3_jaccard_join, op9_exact_dedup

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "decontamination", "packing"]
    columns, before = docs.columns, docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = lasting(stage(spark, docs, DATA))
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    pieces = P.pack(spark, docs, DATA)
    assert pieces.select("doc_id").distinct().count() == before
    kept = {r.doc_id for r in docs.collect()}
    groups = {r.doc_id: r.keep_id for r in op9_exact_dedup(spark, DATA).collect()}
    assert all(groups[d] == d for d in kept)
    parts = {r.doc_id: r.component_id for r in op3_jaccard_join(spark, DATA).collect()}
    assert len({parts[d] for d in kept}) == len(kept)
