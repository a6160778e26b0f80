import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from depsight.llm import components, jaccard
from tests.llm import brute


def check(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_shingles int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(docs, **more).collect()}
    want = brute.components(rows, more.get("percent", 90))
    assert got == want
    return got


def near_group(rng, size, n, most):
    base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randrange(most + 1)):
            w[rng.randrange(n)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_documents(spark):
    docs = spark.read.parquet(f"{brute.DATA}/sf0.01/documents.parquet").where("doc_id < 700")
    got = check(spark, [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()])
    assert len({c for _, c in got.values()}) < len(got)


@pytest.mark.parametrize("crowd", [0, 3, 40])
def test_near_copies_with_and_without_hubs(spark, monkeypatch, crowd):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    rng = random.Random(crowd)
    texts = near_group(rng, 60, 60, 3) + near_group(rng, 30, 200, 12) + near_group(rng, 20, 9, 1) + near_group(rng, 20, 400, 8)
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(12))) for _ in range(60)]
    got = check(spark, list(enumerate(texts)))
    assert len({c for _, c in got.values()}) < len(got)


def test_templates_of_all_sizes(spark, monkeypatch):
    """Documents of one template with more or less of their own, near and beyond the threshold, long ones among them: crowded shingles span many groups."""
    monkeypatch.setattr(jaccard, "CROWD", 3)
    rng = random.Random(11)
    texts = []
    for size, n in ((60, 40), (300, 40), (1600, 14)):
        template = [f"t{size}-{i}" for i in range(size)]
        texts += [" ".join(template + [f"u{rng.randrange(10**7)}" for _ in range(rng.randrange(1 + size // 4))]) for _ in range(n)]
        texts += near_group(rng, 6, size, size // 40)
    for percent in (80, 90):
        got = check(spark, list(enumerate(texts)), percent=percent)
        assert 3 < len({c for _, c in got.values()}) < len(got)


def test_sketches_bound_differences():
    """Folded or not, sketches differ in no more bits than the sets."""
    rng = np.random.default_rng(3)
    for n, m in ((100, 110), (500, 800), (3000, 2600), (9000, 5000)):
        a = rng.integers(0, 2**63, n)
        b = np.concatenate([a[: min(n, m) - 40], rng.integers(0, 2**63, max(m - min(n, m) + 40, 0))])

        def sketch(x):
            longs = max(jaccard.SKETCH, 1 << max(0, round(np.log2(len(x) / 64))))
            return np.bincount(x & (longs * 64 - 1), minlength=longs * 64) & 1

        x, y = sorted((sketch(a), sketch(b)), key=len)
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        assert (x ^ y).sum() <= len(set(a.tolist()) ^ set(b.tolist()))


def test_odd_cases(spark):
    check(spark, [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "ONE\t"), (6, "one two"), (7, "two one"), (8, "a b c"), (9, "A  b\nC"), (10, "É b c"), (11, "é b c"), (12, "x " * 30_000)])
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "q r s t"), (2, "a b c d"), (None, "a b c d"), (3, "q r s t")]
    out = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in out if r["doc_id"]) == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 2, 1)]
    assert [r["component_id"] for r in out if r["doc_id"] is None] == [None]
    assert jaccard.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components.connected(spark.createDataFrame([], "a long, b long")).select(F.count("*")).first()[0] == 0
