"""What indexing a tree moves: statements once, by what they name; nothing of them is gathered by file to learn what a bare specifier means."""

import re

from pyspark.sql import functions as F

from depsight.operators import resolve
from depsight.plans import index, kept
from depsight.sources import derived, store
from depsight.tables import written
from tests.test_tree import frame

TREE = {
    "package.json": '{"workspaces": ["p/*"]}', "p/a/package.json": '{"name": "@o/a", "main": "y.ts"}', "p/b/package.json": '{"name": "@o/b"}', "tsconfig.json": '{"compilerOptions": {"paths": {"@s/*": ["p/a/*"]}}}',
    "p/b/tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@s/*": ["own/*"]}}}', "p/a/y.ts": "", "p/a/x.d.ts": "", "p/b/own/y/index.d.ts": "", "p/b/own/y.js": "", "p/a/y/index.ts": "import '../y'; import '../y/index'; import '../../b/own/y/index.d'",
    "p/a/m.ts": "import './y'; import './y.ts'; import '@o/a'; import '@s/y'; import '@o/a/y.ts'; import './y'; import '@s/gone'; import(`./${q}`)", "p/b/m.ts": "import '@s/y'; import '@o/a'; import 'react'; import 'react/jsx'; import '@s/gone'",
    "top.tsx": "import './p/a/x'; import './p/a/x.d'; import 'react'; import '@o/b/own/y'", "index/index.ts": "import './index'; import '../index'; import '..'", "index.ts": "import './index.ts'; import '.'",
}


def exchanges(df):
    return re.findall(r"Exchange (\w+partitioning\([^)]*\))", df._jdf.queryExecution().executedPlan().toString())


def test_statements_move_once(spark, monkeypatch):
    """Edges inside move by the trunk of what is named, and are distinct there; no table that is written on the way has a row for each statement (F2)."""
    seen = []
    monkeypatch.setattr(resolve, "together", lambda *parts: [resolve.written(x) for x in parts])
    monkeypatch.setattr(resolve, "written", lambda df, name="step": seen.append(df.columns) or written(df, name))
    g = index.build(frame(spark, TREE))
    moves = exchanges(g.inside)  # of templates, statements and files
    assert g.inside.columns == ["file_id", "target"] and len(moves) == 3 and sum("_trunk" in x for x in moves) == 2, moves
    assert not exchanges(g.far) and len(exchanges(g.links())) == len(exchanges(g.inside))
    assert not [columns for columns in seen if {"file_id", "source"} <= set(columns)], seen


def test_an_edge_is_there_once_however_it_is_named(spark):
    """One edge for relative names, packages, aliases, templates that lead to the same file; the nearest configuration decides; names of folders and ends are no mixture (F2)."""
    g = index.build(frame(spark, TREE))
    rows = [tuple(r) for r in g.edges.collect()]
    assert sorted(rows) == sorted(set(rows)) == sorted(map(tuple, g.links().collect())) and set(rows) == {
        ("p/a/m.ts", "p/a/y.ts"), ("p/a/m.ts", "p/a/x.d.ts"), ("p/a/y/index.ts", "p/a/y.ts"), ("p/a/y/index.ts", "p/a/y/index.ts"), ("p/a/y/index.ts", "p/b/own/y/index.d.ts"), ("p/b/m.ts", "p/b/own/y.js"), ("p/b/m.ts", "p/a/y.ts"),
        ("top.tsx", "p/a/x.d.ts"), ("top.tsx", "p/b/own/y.js"), ("index/index.ts", "index/index.ts"), ("index/index.ts", "index.ts"), ("index.ts", "index.ts"),
        ("package:.", "external:react"), ("package:@o/a", "external:@s/gone"), ("package:@o/b", "external:@s/gone"), ("package:@o/b", "external:react"),
    }


def test_pairs_move_no_supplier(spark):
    """Lines that tie by number and part have the same part, so that suppliers, who break ties in the SQL, change no pair (F2)."""
    pairs = derived.pairs(spark, "/root/testdata/sf0.001")
    steps = [x for x in pairs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation" not in x]
    assert any("l_partkey" in x for x in steps) and not any("l_suppkey" in x for x in steps) and pairs.count() > 0


def test_a_first_version_keeps_one_of_equal_rows(spark, tmp_path):
    """Rows that may be there twice are neither counted nor grouped before they are placed; what is surely there once is read without a sum (F1)."""
    rows = spark.range(1000).select((F.col("id") % 700).alias("k"), F.lit("x").alias("v"))
    first = store.Store.create(spark, str(tmp_path / "s"), {"t": (rows, ["k"], 1000), "u": (rows, ["k"])}, per_bucket=50, then=lambda draft: {"w": (draft.all("t").select("k"), ["k"])})
    once = {name: (t.runs[0].once, t.runs[0].rows, t.runs[0].buckets) for name, t in store.Store.open(spark, str(tmp_path / "s")).tables.items()}
    assert once == {"t": (True, 700, 20), "u": (False, 1000, 20), "w": (False, 700, 14)}
    assert {r["n"] for r in first.all("t").collect()} == {1} and {r["n"] for r in first.all("u").where("k < 300").collect()} == {2} and first.all("w").count() == 700
    assert not exchanges(first.all("t")) and exchanges(first.all("u"))
    gone = first.commit({"t": rows.where("k < 200").distinct().withColumn("n", F.lit(-1).cast("long"))})
    assert gone.all("t").count() == 500 and gone.of("t", spark.createDataFrame([(5,), (500,)], "k long")).count() == 1
    store.Store.create(spark, str(tmp_path / "none"), {"t": (rows.limit(0), ["k"], 0)})
    assert store.Store.open(spark, str(tmp_path / "none")).all("t").count() == 0


def test_a_kept_index_writes_targets_where_they_stay(spark, tmp_path, monkeypatch):
    """Of statements only dynamic ones and what names the same are resolved for what is unresolved; targets are written once, as a table of the store (F1)."""
    seen = []
    for where in (index, kept, resolve):
        monkeypatch.setattr(where, "written", lambda df, name="step": seen.append((name, out := written(df, name))) or out)
    files = TREE | {"dyn.ts": "import './gone'; import('./gone'); import('./gone'); import('./top'); import(`./p/b/own/y/${x}`); import('react'); import(y)"}
    g = kept.KeptIndex.create(str(tmp_path / "i"), frame(spark, files))
    built = index.build(frame(spark, files))
    assert {tuple(r) for r in g.edges().collect()} == {tuple(r) for r in built.edges.collect()} and {r["id"] for r in g.nodes().collect()} == {r["id"] for r in built.nodes.collect()}
    assert g.unresolved().first()["n"] == built.unresolved().first()["n"] == 3
    assert g.store.tables["targets"].runs[0].once and not [name for name, _ in seen if name == "targets"]
    assert [df.count() for name, df in seen if name == "dynamic"] == [7, 7]
    assert sorted(map(tuple, g.store.all("incoming").where("target = 'p/a/y.ts'").collect())) == [("p/a/y.ts", x, 1) for x in ("p/a/m.ts", "p/a/y/index.ts", "p/b/m.ts")]
