import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len([k for k in entry.queries() if not k.startswith("op")]) > 100


@needs_data
def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1


@needs_data
def test_sql_gives_the_same_rows(spark):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    from logloom import queries

    for name in ("event_filter", "count_by_type", "call_tree_parent", "limit_summary", "health_score", "kv_latest", "split_segments", "tokenize_events", "preset_merge"):
        got = queries.QUERIES[name](spark, DATA).toPandas()
        want = con.sql(queries.SQL[name]).df()[list(got.columns)]
        rows = lambda d: sorted(map(repr, d.astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
        assert rows(got) == rows(want), name
