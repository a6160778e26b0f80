"""Whitening against numpy's covariance in exact integers, clustering against plain rounds."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from depsight.llm import kmeans, queries, whitening
from tests.llm import brute

ODD = [
    (10**6, None), (10**6 + 1, [1.0, None] * 32), (10**6 + 2, [float("nan")] * 64), (10**6 + 3, [float("inf")] * 64), (10**6 + 4, []), (10**6 + 5, [1.0, 2.0]), (None, [0.25] * 64), (None, [0.25] * 64), (3, [-0.125] * 64),
]
SCHEMA = "vec_id long, embedding array<float>"


@pytest.fixture(scope="module")
def embeddings(spark):
    own = spark.read.parquet(f"{brute.DATA}/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    # columns whose names clash with the operators' own
    return own.union(spark.createDataFrame(ODD, SCHEMA)).withColumns({"v": F.lit(1), "x": F.lit("x"), "N": F.lit(0), "cluster": F.lit(9)}).repartition(5)


def kept(df, dim=64):
    rows = [(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()]
    return [(i, [float(c) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]


def whitening_holds(df, got, dim=64):
    rows = kept(df, dim)
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(row, sums, strict=True)] for row in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = {}
    for (i, _), row, z in zip(rows, x, centred, strict=True):
        deviation = sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True))
        for k in range(min(8, dim)):
            want.setdefault((i, k + 1, n, deviation), []).append(z @ vectors[:, k] / math.sqrt(values[k]))
    found = {}
    for r in got:
        found.setdefault((r["vec_id"], r["component"], r["n"], int(r["deviation"])), []).append(r["whitened"])
    assert found.keys() == want.keys()
    for k in range(1, min(8, dim) + 1):
        mine = np.array([sorted(found[key]) for key in sorted(found, key=str) if key[1] == k and key[0] is not None and len(found[key]) == 1]).ravel()
        theirs = np.array([sorted(want[key]) for key in sorted(want, key=str) if key[1] == k and key[0] is not None and len(want[key]) == 1]).ravel()
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-6
    assert all(len(found[key]) == len(want[key]) for key in want)
    shares = {r["component"]: r["explained"] for r in got}
    assert all(abs(share / (values[k - 1] / values.sum()) - 1) < 1e-9 for k, share in shares.items())
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_whitening(spark, embeddings):
    whitening_holds(embeddings, whitening.whiten(embeddings).collect())


def test_whitening_query(spark):
    got = queries.op11_whitening(spark, f"{brute.DATA}/sf0.001")
    assert dict(got.dtypes)["deviation"] == "bigint" and dict(got.dtypes)["n"] == "bigint"
    whitening_holds(spark.read.parquet(f"{brute.DATA}/sf0.001/embeddings.parquet"), got.collect())


def test_whitening_small_and_flat(spark):
    few = spark.createDataFrame([(i, [float(i), 2.0 * i + (i % 2)]) for i in range(7)] + [(9, [1.0])], SCHEMA)
    whitening_holds(few.where("vec_id < 9"), whitening.whiten(few).collect(), dim=2)
    assert [r["n"] for r in whitening.whiten(few, dim=1).collect()] == [1]
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect()
    assert len(flat) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in flat)
    line = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0])], SCHEMA)).collect()
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True)}
    assert whitening.whiten(few.limit(0)).collect() == [] and whitening.whiten(spark.createDataFrame(ODD[:5], SCHEMA)).count() == 0
    with pytest.raises(Exception, match="beyond"):
        whitening.whiten(spark.createDataFrame([(1, [1e30])], SCHEMA)).collect()


def test_whitening_keeps_what_a_covariance_loses():
    """Two almost parallel columns: the smallest singular value of the factor is exact where the covariance's is noise."""
    rng = np.random.default_rng(1)
    x = rng.integers(-(10**6), 10**6, 4000).astype(float)
    z = np.stack([x, x + rng.choice([-1.0, 1.0], 4000) * 1e-3], axis=1)
    z -= z.mean(axis=0)
    r = np.linalg.qr(np.vstack([np.linalg.qr(part, mode="r") for part in np.split(z, 8)]), mode="r")
    assert abs(np.linalg.svd(r)[1][1] / np.linalg.svd(z, full_matrices=False)[1][1] - 1) < 1e-6


def test_deviation_beyond_long():
    fit = whitening.Fit(2, 3 * 10**9, [3 * 10**9 * 100_500 + 1, 3 * 10**9 * 99_000 + 2])
    found = np.array([[2.0, -5.0]])
    want = sum((fit.n * (math.floor(1024 * c) + 100_000) - s) ** 2 for c, s in zip(found[0].tolist(), fit.sums, strict=True))
    assert fit.deviations(found) == [want] and want > 2**63


def plain_clusters(rows, k=16, rounds=3):
    """rows: (id, integers)."""
    order = sorted(rows, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    at = [list(r[1]) for r in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in rows]
        for j in range(len(at)):
            if mine := [v for (_, v), o in zip(rows, own, strict=True) if o == j]:
                at[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in rows]
    inertia = {j: sum(d for _, o, d in found if o == j) for j in range(len(at))}
    code = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), code[j]) for i, j, d in found), key=str)


def rows_of(df):
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect()), key=str)


def test_clusters(spark, embeddings):
    got = kmeans.cluster(embeddings)
    assert rows_of(got) == plain_clusters([(i, [math.floor(64 * c) for c in v]) for i, v in kept(embeddings)])
    computed, n = got.agg(F.sum("computed"), F.count("*")).first()
    assert n < computed < 0.8 * 4 * 16 * n  # bounds do leave distances out


def test_clusters_query(spark):
    df = spark.read.parquet(f"{brute.DATA}/sf0.001/embeddings.parquet")
    assert rows_of(queries.op12_kmeans(spark, f"{brute.DATA}/sf0.001")) == plain_clusters([(i, [math.floor(64 * c) for c in v]) for i, v in kept(df)])


def test_clusters_ties_and_few_vectors(spark):
    """A grid has many ties; copies of one vector leave centroids empty."""
    grid = [(i, [float(i % 5) / 64, float(i // 5 % 5) / 64]) for i in range(200)]
    df = spark.createDataFrame(grid, "vec_id int, embedding array<double>")
    assert rows_of(kmeans.cluster(df, dim=2)) == plain_clusters([(i, [math.floor(64 * c) for c in v]) for i, v in grid])
    few = [(None, [1.0, 2.0]), (None, [3.0, -4.0]), (5, [1.0, 2.0])]
    assert rows_of(kmeans.cluster(spark.createDataFrame(few, SCHEMA), dim=2)) == plain_clusters([(i, [math.floor(64 * c) for c in v]) for i, v in few])
    alike = [(i, [0.5, 0.5]) for i in range(30)]
    assert rows_of(kmeans.cluster(spark.createDataFrame(alike, SCHEMA), dim=2)) == plain_clusters([(i, [32, 32]) for i, _ in alike])
    assert kmeans.cluster(df.limit(0)).collect() == [] and kmeans.cluster(df).count() == 0


def test_bounds_never_change_the_nearest():
    """Many rounds of moving centroids: with bounds or by all distances, the same."""
    rng = np.random.default_rng(7)
    x, c = rng.integers(-9, 10, (500, 3)), kmeans.Centroids.first(rng.integers(-9, 10, (12, 3)).tolist())
    own, upper, lower = np.zeros(500, np.int64), np.full(500, np.inf), np.zeros((500, 12))
    for _ in range(20):
        own, upper, lower, computed = c.nearest(x, own, upper, lower)
        every = ((x[:, None] - c.at[None]) ** 2).sum(axis=2)
        assert (own == every.argmin(axis=1)).all() and (upper >= np.sqrt(every.min(axis=1))).all() and (lower <= np.sqrt(every)).all()
        c = c.next({j: (int((own == j).sum()), x[own == j].sum(axis=0).tolist()) for j in set(own.tolist())})
    assert computed.sum() < 500 * 6
