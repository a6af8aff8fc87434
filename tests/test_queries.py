"""Every query of the flood engine against its SQL, on the smallest tables."""

import math
import os

import pytest

from tidemark import queries

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda v: ("nan" if math.isnan(v) else f"{v:.9g}") if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sql, name):
    df = queries.QUERIES[name](spark, DATA)
    cursor = sql.execute(queries.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, cursor.fetchall())


def test_regions_cover_all_cells_once(spark):
    found = queries.QUERIES["recurrence_regions"](spark, DATA).agg({"cells": "sum"}).first()[0]
    assert found == queries.QUERIES["populated_cells"](spark, DATA).first()[0]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
