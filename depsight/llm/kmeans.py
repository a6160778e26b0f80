"""Centroid clustering with Elkan's bounds.

Each vector carries, from round to round, an upper bound of the distance to its centroid and a lower bound of the distance to each centroid. When centroids
move, bounds move by as much; a centroid whose lower bound, or half of whose distance from the vector's own centroid, is beyond the upper bound is farther
and isn't looked at. Bounds are rounded to the safe side and only what is strictly farther is left out, so ties are always seen; distances that are looked at
are exact integers, as are sums and centroids. The state of each round is a written table: a lost executor costs one task's work of that round.

Cases: null vectors, those of another length than `dim` and those with a null or non-finite number are left out. Repeated rows count as often as they are
there; equal ids that would both be first centroids go by their vectors; a null id counts as the empty text for its hash and stays null. Fewer vectors than
`k` give fewer centroids. Distances that tie go to the smaller number; a centroid without vectors stays. An empty table gives an empty table. Other columns
are not looked at, whatever their names. Numbers beyond 2^21 are an error, as squared distances couldn't be held by long integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsight.llm.shared import drop, put, table
from depsight.llm.vectors import pieces, scaled, whole

DIM, K, ROUNDS, FACTOR, MOST = 64, 16, 3, 64, 1 << 27
#: More than the rounding of a square root, a sum and a product of doubles.
SLACK = 1e-15
ROWS = 4096


@dataclass
class Centroids:
    """k by dim integers, and how far each may have moved since the bounds were taken: bounded by k and dim."""

    at: np.ndarray
    moved: np.ndarray

    @classmethod
    def first(cls, at: list[list[int]]) -> Centroids:
        return cls(np.array(at, np.int64), np.zeros(len(at)))

    def next(self, sums: dict[int, tuple[int, list[int]]]) -> Centroids:
        """Centroids at the exact floor of their vectors' means; those without vectors stay."""
        at = np.array([[s // sums[k][0] for s in sums[k][1]] if k in sums else row for k, row in enumerate(self.at.tolist())], np.int64)
        return Centroids(at, np.sqrt(((at - self.at) ** 2).sum(axis=1)) * (1 + SLACK))

    def halves(self) -> np.ndarray:
        """Half of each distance between two centroids, rounded down."""
        return np.sqrt(((self.at[:, None] - self.at[None]) ** 2).sum(axis=2)) * (0.5 * (1 - SLACK))

    def nearest(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each row's nearest centroid, its bounds, and how many distances were computed for it."""
        lower = np.maximum(lower - self.moved - SLACK * (lower + self.moved), 0)
        upper = (upper + self.moved[own]) * (1 + SLACK)
        own, halves, computed = own.copy(), self.halves(), np.zeros(len(x), np.int64)
        k = len(self.at)
        near = (lower <= upper[:, None]) & (halves[own] <= upper[:, None])
        near[np.arange(len(x)), own] = False
        open_rows = np.flatnonzero(near.any(axis=1))
        # a bound that leaves a centroid open is made exact first
        exact = np.zeros(len(x), np.int64)
        exact[open_rows] = ((x[open_rows] - self.at[own[open_rows]]) ** 2).sum(axis=1)
        root = np.sqrt(exact[open_rows])
        upper[open_rows], lower[open_rows, own[open_rows]] = root * (1 + SLACK), root * (1 - SLACK)
        computed[open_rows] += 1
        for j in range(k):
            rows = open_rows[(own[open_rows] != j) & (lower[open_rows, j] <= upper[open_rows]) & (halves[own[open_rows], j] <= upper[open_rows])]
            if not len(rows):
                continue
            found = ((x[rows] - self.at[j]) ** 2).sum(axis=1)
            root = np.sqrt(found)
            lower[rows, j] = root * (1 - SLACK)
            computed[rows] += 1
            better = (found < exact[rows]) | ((found == exact[rows]) & (j < own[rows]))
            rows, found, root = rows[better], found[better], root[better]
            own[rows], exact[rows], upper[rows] = j, found, root * (1 + SLACK)
        return own, upper, lower, computed


STATE = "x array<int>, cluster int, upper double, lower array<double>, computed long"


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32()), pa.array(matrix.ravel(), kind))


def _matrix(column: pa.Array, wide: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, wide)


def started(vectors: DataFrame, dim: int) -> DataFrame:
    """vec_id and x of the vectors that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, ROWS):
            rows, found = whole(batch, "v", dim)
            if rows.num_rows:
                yield put(vec_id=rows.column("vec_id"), x=_lists(scaled(found, FACTOR, MOST), pa.int32()))

    return vectors.mapInArrow(run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, x array<int>")


def assigned(state: DataFrame, centroids: Centroids) -> DataFrame:
    """The state after one assignment. state: what started() gives, or what this gave for the centroids before."""
    k, dim, first = *centroids.at.shape, "cluster" not in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, ROWS):
            n, x = batch.num_rows, _matrix(batch.column("x"), dim).astype(np.int64)
            if first:
                own, upper, lower, before = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, k)), 0
            else:
                own, upper, before = (batch.column(c).to_numpy() for c in ("cluster", "upper", "computed"))
                lower = _matrix(batch.column("lower"), k)
            own, upper, lower, computed = centroids.nearest(x, own.astype(np.int64), upper, lower)
            yield put(vec_id=batch.column("vec_id"), x=batch.column("x"), cluster=pa.array(own, pa.int32()), upper=pa.array(upper), lower=_lists(lower, pa.float64()), computed=pa.array(computed + before, pa.int64()))

    return state.mapInArrow(run, f"vec_id {state.schema['vec_id'].dataType.simpleString()}, {STATE}")


def measured(state: DataFrame, centroids: Centroids) -> DataFrame:
    """vec_id, cluster, the exact squared distance to its centroid, and how many distances all rounds computed for the vector."""
    dim = centroids.at.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, ROWS):
            x = _matrix(batch.column("x"), dim).astype(np.int64)
            distance = ((x - centroids.at[batch.column("cluster").to_numpy()]) ** 2).sum(axis=1)
            yield put(vec_id=batch.column("vec_id"), cluster=batch.column("cluster"), distance=pa.array(distance), computed=batch.column("computed"))

    kind = state.schema["vec_id"].dataType.simpleString()
    return state.select("vec_id", "x", "cluster", "computed").mapInArrow(run, f"vec_id {kind}, cluster int, distance long, computed long")


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """For each vector that counts: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, computed."""
    vectors = started(df.select(df[id_col].alias("vec_id"), df[vector_col].cast("array<double>").alias("v")), dim)
    hashed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    seeds = vectors.select(hashed.alias("h"), "x").orderBy("h", "x").limit(k).collect()  # k rows
    if not seeds:
        kind = df.schema[id_col].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, computed long")
    centroids = Centroids.first([x["x"] for x in seeds])
    state = table(assigned(vectors, centroids), "elkan")
    for _ in range(rounds):
        # k rows: each task's sums come first
        found = state.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(dim))).collect()
        centroids = centroids.next({x["cluster"]: (x["n"], [x[f"s{i}"] for i in range(dim)]) for x in found})
        after = table(assigned(state, centroids), "elkan")
        drop(state)
        state = after
    out = table(measured(state, centroids), "clusters")
    drop(state)
    found = {x["cluster"]: x["d"] for x in out.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    sums = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.at.tolist()]
    own = F.element_at(F.array(*(F.lit(found.get(j, 0)).cast("long") for j in range(len(sums)))), F.col("cluster") + 1)
    code = F.element_at(F.array(*map(F.lit, sums)), F.col("cluster") + 1)
    return out.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), F.lit(sum(found.values())).cast("long").alias("inertia"), code.alias("centroid_sha256"), "computed")
