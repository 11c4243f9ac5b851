"""Every core query over the smallest tables, beside its SQL."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from inkwell.plans import graph_queries, kb_queries
from verify import plain

DATA = os.environ.get("INKWELL_TESTDATA", "/root/testdata/sf0.001")
QUERIES, SQL = graph_queries.QUERIES | kb_queries.QUERIES, graph_queries.SQL | kb_queries.SQL


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in SQL:
        return
    rel = duck.sql(SQL[name])
    columns = list(rel.columns)
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(map(plain, r)) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr) == want


def test_entry_without_llm(monkeypatch):
    import importlib

    monkeypatch.setitem(sys.modules, "inkwell.llm", None)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert "p2_found" in entry.queries() and "p7_found" not in entry.queries()
    sys.modules.pop("__spark_entry__", None)
