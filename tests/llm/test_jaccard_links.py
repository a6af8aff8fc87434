"""Counts of links of the Jaccard join against all pairs."""

import random
import re

import pytest

from tidemark.llm import jaccard_links


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain(rows):
    """(id, n_shingles, class_id, n_links) of all rows, each pair compared."""
    sets = [(d, shingles(t)) for d, t in rows]
    out = []
    for i, (d, x) in enumerate(sets):
        n = sum(bool(x) and bool(y) and 100 * len(x & y) >= 80 * len(x | y) for j, (_, y) in enumerate(sets) if i != j)
        out.append((d, len(x), min(e for e, y in sets if y == x) if x else d, n))
    return sorted(out)


def edited(r, words, edits, name):
    w = list(words)
    for _ in range(edits):
        at = r.randrange(len(w))
        kind = r.randrange(3)
        if kind == 0:
            w[at] = f"{name}{r.randrange(10**6)}"
        elif kind == 1 and len(w) > 20:
            del w[at : at + r.randint(1, 4)]
        else:
            w[at:at] = [f"{name}{r.randrange(10**6)}" for _ in range(r.randint(1, 4))]
    return w


def corpus(seed):
    r, rows = random.Random(seed), []
    for g, size in enumerate((40, 300, 90, 200)):  # clouds, with an odd copy in each
        base = [f"g{g}w{i}" for i in range(size)]
        part = [" shared passage of the family that half of them have".split(), []]
        for i in range(r.randint(10, 45)):
            w = edited(r, base, 6 if i == 0 else r.randint(0, 4), f"e{g}")
            at = len(base) // 3
            w[at:at] = part[i % 2] if g % 2 else []
            rows.append(" ".join(w))
    for i in range(25):  # a chain
        rows.append(" ".join(f"c{k}" for k in range(i * 4, i * 4 + 50)))
    for i in range(6):  # pairs, lone ones, short ones
        w = [f"p{i}w{k}" for k in range(60)]
        rows += [" ".join(w), " ".join([*w, "more"]), f"lone {i} text of some seven words", f"two {i % 3}"]
    rows += rows[3:9] + rows[3:6] + [rows[0].upper(), "", None, " \t", rows[-1]]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,block", [(1, 1000), (2, 3)])
def test_link_counts_against_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard_links, "BLOCK", block)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((r.doc_id, r.n_shingles, r.class_id, r.n_links) for r in jaccard_links.similarity_join(df).collect())
    expected = plain(rows)
    assert found == expected
    assert max(n for *_, n in expected) > 10


def test_joined_null_ids_and_no_rows(spark):
    text = "one text of rather more than five words"
    df = spark.createDataFrame([(None, text), (None, text), (7, text.upper()), (None, "alone in here with no link"), (None, None)], "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.n_shingles, r.class_id, r.component_id, r.n_links) for r in jaccard_links.similarity_join(df.withColumnRenamed("doc_id", "x"), "x").withColumnRenamed("x", "doc_id").collect() if r.n_shingles == 4)
    assert found == [(0, 4, 7, 7, 2), (0, 4, 7, 7, 2), (7, 4, 7, 7, 2)]
    lone = [(r.class_id, r.component_id, r.n_links) for r in jaccard_links.similarity_join(df.where("doc_id IS NULL AND text IS NULL OR text LIKE 'alone%'")).collect()]
    assert lone == [(None, None, 0)] * 2
    assert jaccard_links.similarity_join(df.where("doc_id = 0")).count() == 0


def rows_met(spark):
    """The rows that joins of far sets have made so far, by the counts that Spark keeps of each join."""
    store, made = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for run in (runs.apply(i).executionId() for i in range(runs.size())):
        counts, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" in node.name() and "w_x" in node.desc():
                of = [node.metrics().apply(i) for i in range(node.metrics().size())]
                made += sum(int(counts.apply(m.accumulatorId()).split()[-1].replace(",", "")) for m in of if m.name() == "number of output rows" and counts.contains(m.accumulatorId()))
    return made


def far_copies(seed, size, n, most):
    """Copies of one text of `size` words, with up to `most` words replaced by new ones."""
    r, rows = random.Random(seed), []
    for i in range(n):
        w = [f"b{k}" for k in range(size)]
        for k in range(r.randint(0, most)):
            w[r.randrange(size)] = f"n{i}x{k}"
        rows.append((i, " ".join(w)))
    return rows


def test_far_sets_meet_about_as_often_as_they_are_linked(spark):
    rows = far_copies(5, 150, 240, 5)
    before = rows_met(spark)
    found = sorted((r.doc_id, r.n_shingles, r.class_id, r.n_links) for r in jaccard_links.similarity_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == plain(rows)
    sets = [shingles(t) for _, t in rows]
    base = frozenset(tuple(f"b{k + j}" for j in range(5)) for k in range(146))
    weight = [8 * len(s) + 18 * len(base - s) - 9 * len(base) for s in sets]
    far = [(i, j) for i in range(len(sets)) for j in range(i) if weight[i] + weight[j] > 0]
    linked = sum(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for i, j in far)
    met = rows_met(spark) - before
    assert linked > 100
    assert linked <= met <= 5 * linked, f"{met} rows for {linked} links of {len(far)} pairs"


@pytest.mark.parametrize("words", [1, 4])
def test_links_of_sets_with_many_shared_differences(spark, monkeypatch, words):
    monkeypatch.setattr(jaccard_links, "SIGNATURE", words)
    r, rows = random.Random(6), []
    for i in range(90):  # passages that many have replaced alike: more shared differences than a signature has bits
        w = []
        for part in range(30):
            other = r.random() < 0.2
            w += [f"{'other' if other else 'part'}{part}w{k}" for k in range(60)]
        rows.append((i, " ".join(w + [f"own{i}"] * (i % 3))))
    rows += far_copies(7, 150, 40, 5)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    found = sorted((x.doc_id, x.n_shingles, x.class_id, x.n_links) for x in jaccard_links.similarity_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    expected = plain(rows)
    assert found == expected
    assert max(n for *_, n in expected[:90]) > 3
