"""Every registered query of the engine against its SQL, on the smallest tables."""

import math

import pytest

from treeloom import queries as engine

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float) and v.is_integer():
        return int(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(engine.queries()))
def test_query_equals_its_sql(spark, oracle, name):
    df = engine.queries()[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    want = oracle.sql(engine.oracle_sql()[name])
    assert got == table(want.columns, want.fetchall())
