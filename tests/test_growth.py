"""What larger tables ask of queries: results that don't change, and plans whose work is spread."""

import pytest
from pyspark.sql import functions as F

from depsight.functions import paths as P
from depsight.operators import cycles, folders, graphs, reach, resolve
from depsight.plans import index, queries
from depsight.sources import derived, manifests, store
from depsight.tables import written

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_colors_are_worked_out_by_package(spark):
    """Colours don't grow with nodes: none is computed on the rows of nodes (F16)."""
    rows = [("a/x.ts", "p", "file"), ("a/l/x.ts", "p", "file"), ("a/l/deep/y.ts", "p", "file"), ("b/l/x.ts", "q", "file"), ("c.ts", None, "file"), ("external:z", None, "external"), ("a/l/o.ts", "q", "file")]
    nodes = spark.createDataFrame(rows, "id string, package string, kind string")
    libs = spark.createDataFrame([("a/l", "p"), ("a/m", "p"), ("b/l", "q")], "path string, package string")
    found = folders.node_colors(nodes, libs)
    assert "hex(" not in plan(found)
    got = {r["id"]: r["color"] for r in found.collect()}
    assert len(got) == len(rows) and got["external:z"] == "#78808c" and got["c.ts"] == "#6da7e8"
    assert got["a/l/x.ts"] == got["a/l/deep/y.ts"] != got["a/x.ts"]  # a shade of two libraries'
    assert got["b/l/x.ts"] == got["a/l/o.ts"] != got["a/x.ts"]  # a lone library, and a node inside another package's, have their package's colour


def test_uses_are_counted_where_they_are_distinct(spark):
    """Uses are distinct by keys, and are not gathered by names again (F22)."""
    uses = derived.external_uses(spark, SF)
    assert uses.count() == uses.distinct().count() > 0
    assert plan(graphs.refcounts(uses, unique=True)).count("Aggregate") < plan(graphs.refcounts(uses)).count("Aggregate")
    assert sorted(graphs.refcounts(uses, unique=True).collect()) == sorted(graphs.refcounts(uses).collect())


CASES = [
    ("a/b/c", "../d"), ("a/b/c", "../../../d"), ("a/b/c", "../../../../d"), ("a/b/c", "./d"), ("a/b/c", ".."), ("a/b/c", "../"), ("a/b/c", "../.."), ("a", "../b"), ("", "../b"), ("", "b/c"), ("/a/b", "../../../c"),
    ("a/./b", "../c"), ("a//b", "../c"), ("a/../b", "../c"), ("a/b", "../c//d"), ("a/b", "../c/../d"), ("a/b", "../c/./d/"), ("a/b", "c"), ("a/b", "..c/d"), ("a/b", ".../d"), ("../a", "../../c"), ("a/b", ""), ("a/b/", "../c"), ("a/b", "../.d"), ("a/b", "c/..d/e"), (None, "../a"), ("a", None),
]


def test_joined_as_the_walk_over_names(spark):
    df = spark.createDataFrame(CASES, "folder string, spec string")
    walk = P.normalize(F.when(F.col("folder") == "", F.col("spec")).otherwise(F.concat_ws("/", "folder", "spec")))
    for r in df.select("folder", "spec", P.joined(F.col("folder"), F.col("spec")).alias("a"), walk.alias("b")).collect():
        assert r["a"] == r["b"], r


@pytest.mark.parametrize("path", ["", "a", "/", "/a", "a/", "a/b", "a/b/c.ts", "a//b", "ä/ö.ts", "a\n", "a/b\n"])
def test_names_of_paths(spark, path):
    row = spark.createDataFrame([(path,)], "p string").select(P.base_name(F.col("p")), P.dir_name(F.col("p")), P.depth(F.col("p")), P.ancestors(F.col("p"))).first()
    parts = path.split("/")
    assert tuple(row) == (parts[-1], "/".join(parts[:-1]), path.count("/"), ["/".join(parts[:i]) for i in range(len(parts))])


def test_edges_are_distinct_by_keys(spark):
    g = derived.graph(spark, SF)
    assert g.edges.count() == g.edges.distinct().count() > 0


def test_names_are_worked_out_once(spark):
    """Module files are a written table: what reads them repeatedly neither names them nor finds their leads again (F17)."""
    assert "Join" not in plan(derived.files(spark, SF))


def test_rounds_broadcast_no_table_of_nodes(spark, monkeypatch):
    """Every join of the rounds is hinted to be a sort-merge one, so that nothing that grows with nodes goes through the driver (F21)."""
    seen = []

    def kept(df, name="step"):
        seen.append(plan(df))
        return written(df, name)

    monkeypatch.setattr(cycles, "SMALL", 0)
    monkeypatch.setattr(cycles, "written", kept)
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "a"), ("b", "a"), ("y", "y")]
    found = cycles.components(written(spark.createDataFrame(pairs, "src string, dst string")))
    assert sorted(map(tuple, found.collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("y", "y")]
    joins = [line for text in [*seen, plan(found)] for line in text.splitlines() if "Join " in line]
    assert joins and all("strategy=merge" in line for line in joins), [x for x in joins if "strategy=merge" not in x]


def test_the_tree_moves_no_pair_of_names(spark):
    """Statements meet their files by keys: no name of an importer is carried with them, and a name becomes a statement before it is joined (F20)."""
    above, *below = plan(derived.source_tree(spark, SF)).split("strategy=shuffle_hash")
    assert "regexp_replace(regexp_replace" not in above and "regexp_replace(regexp_replace" in below[0]
    moved = [line for line in above.splitlines() if "RepartitionByExpression" in line]
    assert moved and all(line.rstrip(", 0123456789").endswith("L]") for line in moved), moved


def test_answers_are_candidates_backwards(spark):
    """What files answer for is what candidates lead to, for names with many ends (F9)."""
    ends = ["", ".ts", ".d.ts", ".d", ".js", "/index.ts", "/index.d.ts", "/index", "/index.js", ".tsx", ".css", ".cjs"]
    names = sorted({f"{a}{b}{c}" for a in ("", "a", "a/b", "index", "/index") for b in ends for c in ends})
    files = spark.createDataFrame([(n,) for n in names if hash_of(n) % 3], "path string")
    asked = spark.createDataFrame([(n,) for n in [*names, *[n + e for n in names for e in (".x", "/")]]], "k string")
    got, want = (sorted(map(tuple, resolve.probed(asked, F.col("k"), files, ["k"], many=many).collect())) for many in (True, False))
    assert got == want and len(got) > 100


def hash_of(name):
    return sum(map(ord, name))


def test_nodes_resolve_no_relative_import(spark, monkeypatch):
    """Nodes need what leads out of the tree only; relative imports are resolved, not written, when edges are asked for (F9)."""
    seen = []
    for where in (index, resolve):
        monkeypatch.setattr(where, "written", lambda df, name="step": seen.append((name, plan(df))) or written(df, name))
    files = {"a/x.ts": "import './y'; import './y.ts'; import 'z'", "a/y.ts": "import '../b'; import './x.css'", "b/index.ts": "import '../a/x'", "a/x.css": "", "package.json": "{}"}
    g = index.build(spark.createDataFrame(sorted(files.items()), "path string, content string"))
    assert {r["id"] for r in g.nodes.collect()} == {"a/x.ts", "a/y.ts", "b/index.ts", "package:.", "external:z"}
    assert not [n for n, _ in seen if n in ("asked", "edges", "targets")] and not [n for n, text in seen if "min_by" in text and n in ("nodes", "outside")]
    assert {tuple(r) for r in g.edges.collect()} == {("a/x.ts", "a/y.ts"), ("a/y.ts", "b/index.ts"), ("b/index.ts", "a/x.ts"), ("package:.", "external:z")}
    assert g.edges.count() == 4 and g.edges is g.edges


def test_orphans_pass_keys(spark, monkeypatch, tmp_path):
    """Levels pass keys, not names, and edges aren't sorted for each of them; rows are those of names (F18)."""
    seen, few = [], str(tmp_path)
    derived.read(spark, SF, "part").write.parquet(f"{few}/part.parquet")
    derived.read(spark, SF, "lineitem").where("l_orderkey % 40 = 0").write.parquet(f"{few}/lineitem.parquet")
    g = derived.graph(spark, few)
    want = sorted(map(tuple, reach.orphans(g.nodes, g.edges, queries.entry_ids(spark, few)).collect()))
    monkeypatch.setattr(reach, "FEW", 0)
    monkeypatch.setattr(reach, "written", lambda df, name="step": seen.append((name, df.schema.simpleString(), plan(df))) or written(df, name))
    found = queries.orphans(spark, few)
    assert found.columns == ["id", "unreachable", "no_incoming"] and sorted(map(tuple, found.collect())) == want
    assert len({r[1:] for r in want}) > 1
    assert {s for n, s, _ in seen if n == "ends"} == {"struct<_from:bigint,_to:bigint>"}
    levels = [text for n, _, text in seen if n == "level" and "_from" in text]
    assert levels and all("strategy=shuffle_hash" in text for text in levels)
    assert all(any(h in g for h in manifests.TEST_HINTS) for g in manifests.TEST_GLOBS)


def test_large_changes_go_by_buckets(spark, tmp_path):
    """A change of more rows than a bucket's is not written by one task, and a first version's rows move once, not twice to be summed (F7)."""
    rows = lambda lo, hi, n: spark.range(lo, hi).select(F.col("id").alias("k"), F.lit(n).cast("long").alias("n"))
    first = store.Store.create(spark, str(tmp_path / "s"), {"t": (rows(0, 1000, 1).union(rows(0, 10, 1)), ["k"])}, per_bucket=50)
    assert {r["n"] for r in first.all("t").where("k < 10").collect()} == {2} and first.all("t").count() == 1000
    second = first.commit({"t": rows(0, 300, -1)})
    assert [r.buckets for r in second.tables["t"].runs] == [21, 6]
    assert second.all("t").count() == 710 and second.of("t", spark.createDataFrame([(5,), (500,), (250,)], "k long")).count() == 2
