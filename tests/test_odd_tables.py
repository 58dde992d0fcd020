"""Queries beside their SQL on small tables with rows that the given ones don't hold."""

import pytest
from test_engine import table

from treeloom import queries as engine

duckdb = pytest.importorskip("duckdb")


def beside_sql(spark, folder, name, **tables):
    """Rows of the query and of its SQL over ``tables`` (DataFrames)."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df = engine.queries()[name](spark, str(folder))
    want = con.sql(engine.oracle_sql()[name])
    return table(df.columns, [tuple(r) for r in df.collect()]), table(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["node_counts_by_kind", "escape_roundtrip_documents", "event_stream_counts", "serialize_documents_md5", "first_instruction", "xml_to_json_roundtrip_rebuild"])
def test_long_and_empty_texts(spark, tmp_path, name):
    texts = ["short", "a & b\n" * 30_000, "", "é" * 70_000, "<" * 70_000, " ", "a ><t/><!-- n --> b"]
    rows = [(k, t, "en", "web", len(t)) for k, t in enumerate(texts)]
    got, want = beside_sql(spark, tmp_path, name, documents=spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert got == want


@pytest.mark.parametrize("name", ["first_child_by_name", "path_selector_descendant"])
def test_documents_that_several_branches_read_are_parsed_once(spark, name):
    plan = engine.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan  # what was parsed is read from the shared folder


def test_manifests_hold_a_block_of_customers_at_most(spark, monkeypatch):
    from treeloom.queries import suites

    told = []
    monkeypatch.setattr(suites, "BLOCK", 20, raising=False)
    monkeypatch.setattr(suites, "run_suite", lambda manifests, files, f=suites.run_suite: told.append(manifests) or f(manifests, files))
    con = duckdb.connect()
    for t in ("nation", "customer"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    df, want = suites.suite_by_region(spark, "/root/testdata/sf0.001"), con.sql(engine.oracle_sql()["suite_by_region"])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(want.columns, want.fetchall())
    held = [r.xml.count("<t:instanceTest ") for r in told[0].collect()]
    assert sum(held) == 150 and max(held) <= 20
