"""The Merkle manifest against the whole tree built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle
from tidemark.llm.common import ascii_lower

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def lower(t):
    return t and t.translate({c: c + 32 for c in range(65, 91)})


def tree(nodes):
    """(the root, each leaf's levels of (place, others))."""
    ways, spots, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[k : k + 8] for k in range(0, len(level), 8)]
        for way, i in zip(ways, spots, strict=True):
            run = runs[i // 8]
            way.append((i % 8, run[: i % 8] + run[i % 8 + 1 :]))
        spots, level = [i // 8 for i in spots], [sha("".join(run)) for run in runs]
    return level[0], ways


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault((row[2] is not None, (row[2] or "").encode()), []).append(row)
    found, subroots = [], []
    for key in sorted(groups):
        members = sorted(groups[key], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subroot, ways = tree([leaf(r) for r in members])
        subroots.append(subroot)
        found.append((members, ways, subroot))
    root, above = tree(subroots)
    out = []
    for (members, ways, subroot), upper in zip(found, above, strict=True):
        for row, way in zip(members, ways, strict=True):
            bent = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            node = leaf((*row[:4], lower(row[4]))) if bent else leaf(row)
            for place, others in way + upper:
                node = sha("".join([*others[:place], node, *others[place:]]))
            out.append((row[0], leaf(row), subroot, root, sha("".join(x for _, others in way + upper for x in others)), node, node == root))
    return sorted(out, key=str)


def computed(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    docs = docs.withColumn("id", F.lit("clash")).withColumn("grp", F.lit(1)).withColumn("leaf", F.lit(2)).withColumn("rank", F.lit(3)).repartition(3)
    bent = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return merkle.manifest(merkle.leaves(docs, COLUMNS, "lang", "doc_id", {"text": ascii_lower(F.col("text"))}, bent), **more)


def corpus():
    r = random.Random(5)
    text = lambda: "".join(r.choice("aBcé 漢𝄞\n") for _ in range(r.randint(0, 30)))
    rows = [(i, f"s{i % 3}", "en", i, text()) for i in r.sample(range(5000), 900)]
    rows += [(i, None, "de", None, text()) for i in range(65)] + [(i, "s", None, 1, text()) for i in range(9)] + [(7, "s", "fr", 1, "lone")]
    rows += [(3, "s", "de", 1, None), (4, "s", "de", 1, ""), (None, "s", "de", 1, "A"), (None, "t", "de", 1, "A"), (3, "s", "de", 1, None)]  # nulls, ties, repeated rows
    return rows + [(40 + i, "s", f"l{i:02d}", 1, "Several groups") for i in range(20)] + [(8, "s", "", 1, "group of an empty name"), (9, "s", "es", 1, "X" * 2_000_000)]


def test_manifest_is_the_whole_tree(spark):
    rows = corpus()
    assert merkle.FAN**merkle.LEVELS < 900  # a group of several blocks
    found = computed(spark, rows).drop("grp").collect()
    assert sorted(map(tuple, found), key=str) == expected(rows)


def test_three_steps_of_blocks(spark):
    rows = corpus()
    found = computed(spark, rows, levels=1).drop("grp").collect()
    assert sorted(map(tuple, found), key=str) == expected(rows)


@pytest.mark.parametrize("n", [1, 9])
def test_small_tables(spark, n):
    rows = [(i, "s", "en", 1, f"Text {i}") for i in range(n)]
    assert sorted(map(tuple, computed(spark, rows).drop("grp").collect()), key=str) == expected(rows)


def test_no_rows(spark):
    assert computed(spark, []).count() == 0


def test_proofs_lead_to_the_root(spark):
    rows = [(i, "s", f"l{i % 3}", 1, "text") for i in range(200)]
    for r in computed(spark, rows, proofs=True).collect():
        assert merkle.fold(r.leaf, [(p.place, p.others) for p in r.path]) == r.root


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 100, 511, 512])
def test_traversal_holds_few_nodes(n):
    nodes = [sha(str(i)) for i in range(n)]
    root, ways = tree(nodes)
    levels = merkle.levels_of(n, 3)
    assert merkle.head(nodes, levels) == root
    assert [merkle._others(steps) for steps in merkle.traverse(nodes, levels)] == ways
