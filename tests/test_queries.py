"""Every query of the graph part against its SQL in DuckDB, and the entry points."""

import importlib
import sys

import duckdb
import pytest

from depsight.plans import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return list(value) if hasattr(value, "tolist") and getattr(value, "ndim", 0) else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    said = duck.execute(queries.ORACLE_SQL[name])
    assert rows_of(df.columns, df.collect()) == rows_of([x[0] for x in said.description], said.fetchall())


def test_entry_works_without_the_llm_folders(spark, monkeypatch):
    for name in [x for x in sys.modules if x.startswith("depsight.llm") or x in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "depsight.llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(queries.QUERIES) and set(entry.oracle_sql()) == set(queries.ORACLE_SQL)
    assert entry.entry(spark).columns
    monkeypatch.delitem(sys.modules, "__spark_entry__")
