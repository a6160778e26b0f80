"""An index that is kept between changes: random changes against building anew, cost by rows, restarts, writers at once."""

import json
import os
import random

import pytest

from depsight.plans import index
from depsight.plans.kept import KeptIndex
from depsight.sources import store
from tests.test_tree import BASE, frame


#: Changes in a row, each of which takes ten seconds or more on one machine; twenty have been run, too.
CHANGES = int(os.environ.get("KEPT_CHANGES", "6"))


def changed(spark, rows):
    return spark.createDataFrame([(p, t, t is None) for p, t in sorted(rows.items())], "path string, content string, removed boolean")


def graph_of(g):
    nodes, edges = (g.nodes(), g.edges()) if isinstance(g, KeptIndex) else (g.nodes, g.edges)
    return {tuple(r) for r in nodes.select("id", "path", "label", "package", "kind").collect()}, {tuple(r) for r in edges.collect()}


def diff_of(old, new):
    """op, entity, id, src, dst between two graphs."""
    (a, e), (b, f) = ({n[0] for n in old[0]}, old[1]), ({n[0] for n in new[0]}, new[1])
    return {("remove", "node", x, None, None) for x in a - b} | {("add", "node", x, None, None) for x in b - a} | {("remove", "edge", None, *x) for x in e - f} | {("add", "edge", None, *x) for x in f - e}


def test_counts(spark, tmp_path):
    """The last use of an external package takes its edge and nodes along; a removed file what led to it; a broken file its imports but not its node."""
    g = KeptIndex.create(str(tmp_path / "i"), frame(spark, BASE), root_name="top")
    built = index.build(frame(spark, BASE), root_name="top")
    assert graph_of(g) == graph_of(built) and g.unresolved().first()["n"] == built.unresolved().first()["n"] == 1
    g, diff = g.apply(changed(spark, {"p/a/index.ts": "import './x'"}))
    assert {tuple(r) for r in diff.collect()} == {("remove", "edge", None, "package:@o/a", "external:react"), ("remove", "node", "package:@o/a", None, None)}
    g, diff = g.apply(changed(spark, {"p/a/x.ts": None, "p/b/y.ts": "import 'vue'", "new.ts": "import './consumer'", "readme.md": "x"}))
    assert {tuple(r) for r in diff.collect()} == {
        ("remove", "node", "p/a/x.ts", None, None), ("remove", "edge", None, "p/a/index.ts", "p/a/x.ts"), ("remove", "edge", None, "p/b/y.ts", "p/a/index.ts"), ("remove", "edge", None, "package:@o/b", "external:react"), ("remove", "node", "external:react", None, None),
        ("add", "node", "external:vue", None, None), ("add", "edge", None, "package:@o/b", "external:vue"), ("add", "node", "new.ts", None, None), ("add", "edge", None, "new.ts", "consumer.ts"),
    }
    g, diff = g.apply(changed(spark, {"new.ts": "import { from", "broken.ts": "import './new'; import(q)"}))
    assert {tuple(r) for r in diff.collect()} == {("remove", "edge", None, "new.ts", "consumer.ts"), ("add", "edge", None, "broken.ts", "new.ts")}
    assert [r["path"] for r in g.store.all("errors").collect()] == ["new.ts"] and g.unresolved().first()["n"] == 2
    g, diff = g.apply(changed(spark, {"broken.ts": "import './new'; import(q)", "gone.ts": None}))
    assert diff.count() == 0 and g.unresolved().first()["n"] == 2


def text_of(rng, names):
    lines = [f"import './{rng.choice(names)}'" for _ in range(rng.randrange(3))] + [f"import '{rng.choice(['react', 'vue', '@s/x/y', '@o/b0'])}'" for _ in range(rng.randrange(3))]
    return "\n".join(lines) if rng.random() < 0.9 else "import { from"


def test_random_changes_equal_building_anew(spark, tmp_path, monkeypatch):
    """CHANGES changes in a row; runs are merged on the way, old versions go, and the index is opened again from its folder each time."""
    rng = random.Random(6)
    names = [f"p/{'ab'[i % 2]}/f{i}" for i in range(14)]
    files = {"package.json": '{"workspaces": ["p/*"]}', "p/a/package.json": '{"name": "@o/a0"}', "p/b/package.json": '{"name": "@o/b0", "main": "f1.ts"}', "p/b/index.ts": ""}
    above = lambda: [f"../../{n}" for n in names]
    files |= {f"{n}.ts": text_of(rng, above()) for n in names}
    KeptIndex.create(str(tmp_path / "i"), frame(spark, files), per_bucket=3)
    before = graph_of(index.build(frame(spark, files)))
    for k in range(CHANGES):
        rows = {}
        for n in rng.sample(names, rng.randrange(1, 4)):
            if f"{n}.ts" not in files:  # a file that comes back: those that name it are read again, too
                rows |= {p: t for p, t in files.items() if n in t and p.endswith(".ts")}
                rows[f"{n}.ts"] = text_of(rng, above())
            else:
                rows[f"{n}.ts"] = None if rng.random() < 0.3 and n != "p/b/f1" else text_of(rng, above())
        files = {p: t for p, t in (files | rows).items() if t is not None}
        g, diff = KeptIndex.open(spark, str(tmp_path / "i")).apply(changed(spark, rows), batch=k)
        now = graph_of(g)
        assert {tuple(r) for r in diff.collect()} == diff_of(before, now), k
        if k == CHANGES - 1:
            assert now == graph_of(index.build(frame(spark, files))), k
        before = now
    assert KeptIndex.open(spark, str(tmp_path / "i")).apply(changed(spark, {"p/a/f0.ts": None}), batch=CHANGES - 1)[1] is None
    assert len(store.Files(spark, str(tmp_path / "i")).versions()) == store.KEPT
    assert all(len(t.runs) <= 6 for t in g.store.tables.values())
    there = {x.name for x in (tmp_path / "i").iterdir() if x.is_dir()}
    specs = [json.loads(x.read_text()) for x in (tmp_path / "i").glob("version-*.json")]
    assert there == {r["path"] for x in specs for t in x["tables"].values() for r in t["runs"]}


def test_a_change_costs_its_own_size(spark, tmp_path, monkeypatch):
    """Rows in the buckets that a change of two files reads, and rows that it writes, are few beside the index."""
    size = 1600
    files = {f"d{i % 20}/f{i}.ts": f"import '../d{(i + 1) % 20}/f{i + 1}'; import 'e{i % 50}'" for i in range(size)}
    g = KeptIndex.create(str(tmp_path / "i"), frame(spark, files), per_bucket=20)
    read, plain = [], store.Store.paths

    def counted(self, name, keys=None):
        out = plain(self, name, keys)
        read.append(spark.read.parquet(*out).count() if out else 0)
        return out

    monkeypatch.setattr(store.Store, "paths", counted)
    runs = {r.path: r.rows for t in g.store.tables.values() for r in t.runs}
    g, diff = g.apply(changed(spark, {"d3/f3.ts": "import '../d9/f9'; import 'new'", "d5/f25.ts": None}))
    assert diff.count() == 7
    assert sum(read) < sum(runs.values()) / 5 and sum(r.rows for t in g.store.tables.values() for r in t.runs if r.path not in runs) < 40


def test_two_writers_at_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    one = store.Store.create(spark, str(tmp_path / "s"), {"t": (rows, ["k"])})
    with pytest.raises(store.Taken):
        store.Store.create(spark, str(tmp_path / "s"), {"t": (rows, ["k"])})
    other = store.Store.open(spark, str(tmp_path / "s"))
    won = one.commit({"t": spark.createDataFrame([("c", 3, 1), ("a", 1, -1)], "k string, v int, n long")})
    with pytest.raises(store.Taken):
        other.commit({"t": spark.createDataFrame([("d", 4, 1)], "k string, v int, n long")})
    found = store.Store.open(spark, str(tmp_path / "s"))
    assert found.version == won.version == 1 and {(r["k"], r["v"], r["n"]) for r in found.all("t").collect()} == {("b", 2, 1), ("c", 3, 1)}
    assert {r["k"] for r in found.of("t", spark.createDataFrame([("a",), ("c",), ("z",), (None,)], "k string")).collect()} == {"c"}
    assert found.commit({"t": spark.createDataFrame([("b", 2, -1), ("c", 3, -1)], "k string, v int, n long")}).all("t").count() == 0
    with pytest.raises(FileNotFoundError):
        store.Store.open(spark, str(tmp_path / "none"))
