"""Reachability and cycles against plain Python on random graphs and the known small cases."""

import random

import pytest

from depsight.operators import cycles, graphs, reach


def frame(spark, rows, names):
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{n} string" for n in names))


def closure(edges):
    """For each node the set that it leads to by one edge or more."""
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = {}
    for a in after:
        seen, todo = set(), list(after[a])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after.get(x, ())
        out[a] = seen
    return out


def components(edges):
    to = closure(edges)
    return {a: min(x for x in to[a] if a in to.get(x, ())) for a in to if a in to[a]}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02}" for i in range(24)]
    edges = {(rng.choice(names), rng.choice(names)) for _ in range(26 + 4 * seed)}
    e, nodes = frame(spark, edges, ("src", "dst")), frame(spark, [(n,) for n in names], ("id",))
    to = closure(edges)
    assert {r["id"]: r["scc"] for r in cycles.components(e).collect()} == components(edges)
    start = names[3]
    assert {r["id"] for r in reach.dependents(e, frame(spark, [(start,)], ("id",))).collect()} == {a for a in to if start in to[a]}
    entries = set(names[:2]) | {"gone"}
    seen = {x for n in entries for x in to.get(n, ())} | entries
    assert {r["id"] for r in reach.unreachable(nodes, e, frame(spark, [(n,) for n in entries], ("id",))).collect()} == set(names) - seen


@pytest.mark.parametrize("shape", ["path", "ring", "rings and trees"])
def test_rounds_do_not_follow_the_diameter(spark, monkeypatch, shape):
    """10,000 nodes in a row take a logarithmic number of rounds, whatever their names."""
    rng, n = random.Random(3), 10_000
    names = [f"n{i}" for i in range(n)]
    rng.shuffle(names)
    pairs, want = list(zip(names, names[1:])), {}
    if shape == "ring":
        pairs, want = [*pairs, (names[-1], names[0])], dict.fromkeys(names, min(names))
    if shape == "rings and trees":  # two rings of 1,000, on which chains and trees hang that lead away from them
        rings = [names[:1000], names[1000:2000]]
        pairs = [(r[i - 1], r[i]) for r in rings for i in range(1000)] + [(names[rng.randrange(max(0, i - 3000), i) if i % 3 else i - 1], names[i]) for i in range(2000, n)]
        want = {x: min(r) for r in rings for x in r}
    steps, plain = [], cycles.written
    monkeypatch.setattr(cycles, "written", lambda df, name="step": steps.append(name) or plain(df, name))
    got = {r["id"]: r["scc"] for r in cycles.components(frame(spark, pairs, ("src", "dst"))).collect()}
    assert got == want and sum(x in ("jump", "numbers") for x in steps) <= 2 * 13.3


def test_least_numbers_leap(spark, monkeypatch):
    """A ring whose nodes all have two incoming and two outgoing edges has no chains."""
    n = 600
    names = [f"n{i * 7919 % n:03}" for i in range(n)]
    pairs = [(names[i], names[(i + k) % n]) for i in range(n) for k in (1, 2)]
    steps, plain = [], cycles.written
    monkeypatch.setattr(cycles, "written", lambda df, name="step": steps.append(name) or plain(df, name))
    assert {r["id"]: r["scc"] for r in cycles.components(frame(spark, pairs, ("src", "dst"))).collect()} == dict.fromkeys(names, "n000")
    assert steps.count("numbers") < 60


def test_many_graphs_at_once(spark, monkeypatch):
    """Graphs that share names, some at rest long before others; null ends and null graphs are on no cycle."""
    monkeypatch.setattr(cycles, "FEW_MOVE", 0.9)
    rng, graphs_ = random.Random(8), {}
    for g in range(30):
        n = rng.choice([2, 5, 9, 14])
        graphs_[f"g{g}"] = {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(int(1.4 * n))}
    graphs_["long"] = {(f"n{i}", f"n{(i + k) % 40}") for i in range(40) for k in (1, 2)}
    rows = [(g, a, b) for g, e in graphs_.items() for a, b in e] + [(None, "n0", "n1"), (None, "n1", "n0"), ("g0", None, "n0"), ("g0", "n0", None)]
    df = frame(spark, rows, ("month", "src", "dst"))
    assert {(r["month"], r["id"]): r["scc"] for r in cycles.components(df, "month").collect()} == {(g, a): s for g, e in graphs_.items() for a, s in components(e).items()}
    whole = {(g, x) for g, e in graphs_.items() for pair in e for x in pair}
    nodes, entries = frame(spark, whole, ("month", "id")), frame(spark, [(g, "n1") for g in graphs_], ("month", "id"))
    seen = {(g, x) for g, e in graphs_.items() for x in closure(e).get("n1", set()) | {"n1"}}
    assert {tuple(r) for r in reach.unreachable(nodes, df.where("month IS NOT NULL"), entries, "month").collect()} == whole - seen


@pytest.mark.parametrize("few", [0, 50_000])
def test_levels_leave_edges_behind(spark, monkeypatch, few):
    """Edges that lead to nothing new and graphs at rest go, and a query broadcasts no table for each level."""
    monkeypatch.setattr(reach, "STRIDE", 3)
    monkeypatch.setattr(reach, "FEW", few)
    shapes = {"long": [(f"n{i:02}", f"n{i + 1:02}") for i in range(12)], "short": [("n00", f"n{i:02}") for i in range(1, 30)], "ring": [(f"n{i:02}", f"n{(i + 1) % 5:02}") for i in range(5)]}
    edges = frame(spark, [(g, *e) for g, es in shapes.items() for e in es], ("month", "src", "dst"))
    left, casts, plain = [], [], reach.written

    def counted(df, name="step"):
        casts.append(df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange"))
        out = plain(df, name)
        left.extend([out.count()] if name == "ends" else [])
        return out

    monkeypatch.setattr(reach, "written", counted)
    got = reach.reached(edges, frame(spark, [(g, "n00") for g in shapes], ("month", "id")), graph="month").collect()
    assert sorted(tuple(r) for r in got) == sorted((g, x) for g, es in shapes.items() for x in closure(es)["n00"])
    assert left == [46, 11, 6, 3, 0]
    assert max(casts) <= 2  # the frontier, or when edges go what was seen and the graphs that go on


def test_small_cases(spark):
    a3 = frame(spark, [("a", "b"), ("b", "c"), ("c", "a")], ("src", "dst"))
    assert {r["id"]: r["scc"] for r in cycles.components(a3).collect()} == dict.fromkeys("abc", "a")
    assert {r["id"] for r in reach.dependents(a3, frame(spark, [("b",)], ("id",))).collect()} == set("abc")
    loop = frame(spark, [("a", "a"), ("a", "b")], ("src", "dst"))
    assert [tuple(r) for r in cycles.components(loop).collect()] == [("a", "a")]
    lone = frame(spark, [("x", "y")], ("src", "dst"))
    assert reach.dependents(lone, frame(spark, [("q",)], ("id",))).count() == 0
    _, edges = graphs.visible(frame(spark, [(n,) for n in "abc"], ("id",)), a3, frame(spark, [("b",)], ("id",)))
    assert cycles.components(edges).count() == 0


def test_barrel_cones(spark):
    edges = frame(spark, [("f", "B"), ("B", "target")], ("src", "dst"))
    mapping = frame(spark, [("m1", "B"), ("m2", "B"), ("f", "f"), ("target", "target")], ("raw_id", "display_id"))
    cone = lambda n: {r["id"] for r in reach.dependents_with_barrels(edges, frame(spark, [(n,)], ("id",)), mapping).collect()}
    assert cone("m1") == {"f"} and cone("target") == {"B", "m1", "m2", "f"} and cone("nothing") == set()
    ring = frame(spark, [("a", "b"), ("b", "a")], ("src", "dst"))
    assert {r["id"] for r in reach.dependents_with_barrels(ring, frame(spark, [("a",)], ("id",)), mapping).collect()} == {"b"}
    nodes = spark.createDataFrame([("f", "file", "p"), ("target", "file", "q")], "id string, kind string, package string")
    row = reach.cone_stats(frame(spark, [("B",), ("barrel:x",), ("f",), ("gone",)], ("id",)), nodes).first()
    assert (row["files"], row["packages"]) == (3, 1)


def test_orphans(spark):
    nodes, edges = frame(spark, [("entry",), ("a",), ("b",)], ("id",)), frame(spark, [("entry", "entry"), ("a", "b"), ("b", "a")], ("src", "dst"))
    rows = {r["id"]: (r["unreachable"], r["no_incoming"]) for r in reach.orphans(nodes, edges, frame(spark, [("entry",)], ("id",))).collect()}
    assert rows == {"a": (True, False), "b": (True, False)}
    chain = frame(spark, [("entry", "a"), ("a", "b")], ("src", "dst"))
    rows = {r["id"]: (r["unreachable"], r["no_incoming"]) for r in reach.orphans(nodes, chain, frame(spark, [("entry",)], ("id",))).collect()}
    assert rows == {"entry": (False, True)}
