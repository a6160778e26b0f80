"""Components by tasks of small graphs and by rounds, of few edges first where they are dense, against plain Python."""

import random

import pytest

from depsight.operators import cycles
from tests import test_fixpoints as fixpoints
from tests.test_fixpoints import components, frame


def test_rounds_leap_without_small_graphs(spark, monkeypatch):
    monkeypatch.setattr(cycles, "SMALL", 0)
    fixpoints.test_least_numbers_leap(spark, monkeypatch)


@pytest.mark.parametrize(("small", "dense"), [(15, 1), (1000, 8)])
def test_graphs_of_any_size(spark, monkeypatch, small, dense):
    """Graphs below and above the bound, thin and dense ones, loops and edges given twice."""
    monkeypatch.setattr(cycles, "SMALL", small)
    monkeypatch.setattr(cycles, "DENSE", dense)
    rng, graphs = random.Random(small + dense), {}
    for g in range(6):
        n = rng.choice([2, 5, 9, 14, 30])
        graphs[f"g{g}"] = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(int(rng.choice([1.2, 2, 4]) * n))]
    # dense blocks in a row, of which only the first two lie on a cycle
    graphs["blocks"] = [(f"b{b}x{i}", f"b{b}x{j}") for b in range(4) for i in range(6) for j in range(6) if i != j] + [(f"b{b}x0", f"b{b + 1}x3") for b in range(3)] + [("b1x5", "b0x5")]
    rows = [(g, *e) for g, es in graphs.items() for e in es]
    got = cycles.components(frame(spark, rows, ("month", "src", "dst")), "month").collect()
    want = {(g, a): s for g, es in graphs.items() for a, s in components(set(es)).items()}
    assert {(r["month"], r["id"]): r["scc"] for r in got} == want and len(got) == len(want)


def test_small_graphs_take_no_rounds(spark, monkeypatch):
    """What a graph of few edges writes doesn't grow with its cycles' length."""
    steps, plain = [], cycles.written
    monkeypatch.setattr(cycles, "written", lambda df, name="step": steps.append(name) or plain(df, name))
    rows = [(f"g{g}", f"n{i}", f"n{(i + k) % 50}") for g in range(20) for i in range(50) for k in (1, 2)]
    assert {r["scc"] for r in cycles.components(frame(spark, rows, ("month", "src", "dst")), "month").collect()} == {"n0"}
    assert steps == ["sizes"]
