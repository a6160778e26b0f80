"""Line dedup by the ratio alone: small hosts and pages of nothing but boilerplate."""

import duckdb

import corpus_pipeline
from depsight.llm import lines, queries
from tests.llm import brute
from tests.test_queries import rows_of


def test_small_hosts_and_covered_pages(spark):
    rows = [(1, "small", "menu\none"), (2, "small", "menu\ntwo"), (3, "small", "three"), (4, "small", "menu"), (5, "small", None), (6, "lone", "menu\nmenu")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r["doc_id"]: (r["text"], r["n"]) for r in lines.dedup(docs, n_dropped="n").collect()}
    assert got == {1: ("one", 1), 2: ("two", 1), 3: ("three", 0), 4: ("", 1), 5: (None, 0), 6: ("menu\nmenu", 0)}
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_lines(spark, docs, "").collect()} == {i: t for i, (t, _) in got.items()}


def test_same_rows_as_sql(spark):
    d = f"{brute.DATA}/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet')")
    said, df = con.execute(queries.ORACLE_SQL["op1_line_dedup"]), queries.QUERIES["op1_line_dedup"](spark, d)
    rows = df.collect()
    assert rows_of(df.columns, rows) == rows_of([x[0] for x in said.description], said.fetchall())
    assert sum(r["n_dropped"] for r in rows) > 0


def test_clashing_columns_keep_their_values(spark):
    rows = [(i, "a" if i % 2 else None, f"menu\n{'x' * 200_000 if i == 3 else i}", 7, 8, 9) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, Host int, boiler int, hits int")
    got = lines.dedup(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == sorted((i, s, t.split("\n")[1], *x) for i, s, t, *x in rows)
