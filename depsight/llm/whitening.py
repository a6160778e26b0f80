"""Whitening of embeddings by a tall and skinny QR factorisation (TSQR).

Numbers become integers x, so that the sums of each dimension are exact. Each task centres its rows by these sums and keeps the triangular factor R of them,
a batch at a time; factors are stacked and factored again in a tree, SIXTEEN to one, until one is left. Its singular value decomposition gives the principal
directions (right vectors) and variances (squared singular values over n): no covariance of the input is formed, so small variances keep their digits.

Cases: null vectors, empty ones and those with a null or non-finite number are left out. Vectors of a length other than the commonest one (of lengths that tie
the larger) have no place among the dimensions and are left out too; `dim` fixes the length. Repeated rows count as often as they are there; a null id stays
null. An empty table gives an empty table. Of vectors with fewer than 8 dimensions there are as many components. A component without variance (all rows
alike, or fewer rows than dimensions) has `whitened` null and isn't in `identity_error`; where no component has variance, `explained` and `identity_error`
are null. `deviation` is exact as a decimal. Other columns are not looked at, whatever their names. Numbers beyond 10^9 are an error, as long integers
couldn't hold what is asked of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsight.llm.shared import drop, put, table
from depsight.llm.vectors import STEP_NUMBERS, lengths, pieces, scaled, whole

FACTOR, SHIFT, MOST = 1024, 100_000, 1 << 40
COMPONENTS, SIXTEEN = 8, 16
#: Singular values below this share of the largest are rounding.
NOTHING = 1e-12


@dataclass
class Fit:
    """What all tasks need: bounded by the number of dimensions."""

    dim: int
    n: int
    sums: list[int]
    directions: np.ndarray | None = None
    variances: np.ndarray | None = None
    total: float = 0.0

    def integers(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """y and r with n * x - S = n * y - r, 0 <= r < n, so that y is small where x is near the mean."""
        whole_part, rest = np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n for s in self.sums], np.int64)
        return scaled(found, FACTOR, MOST) + SHIFT - whole_part, rest

    def centred(self, found: np.ndarray) -> np.ndarray:
        y, rest = self.integers(found)
        return y - rest / self.n

    def deviations(self, found: np.ndarray) -> list[int]:
        """For each row the exact sum over dimensions of (n * x - S)^2."""
        y, rest = self.integers(found)
        widest = (int(np.abs(y).max(initial=0)) + 1) * self.n
        if self.dim * widest**2 < 1 << 63:
            return ((self.n * y - rest) ** 2).sum(axis=1).tolist()
        rows, rests = y.tolist(), rest.tolist()
        return [sum((self.n * a - b) ** 2 for a, b in zip(row, rests, strict=True)) for row in rows]

    @property
    def real(self) -> int:
        """Components that have variance."""
        return int((self.variances > self.variances.max(initial=0) * NOTHING**2).sum())

    def whitened(self, found: np.ndarray) -> np.ndarray:
        own = self.real
        return self.centred(found) @ (self.directions[:, :own] / np.sqrt(self.variances[:own]))


def sums(vectors: DataFrame, dim: int | None) -> Fit | None:
    """The length, the number and the exact sums of the vectors that count; None where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}

        def out() -> pa.RecordBatch:
            rows = [(k, i, n, Decimal(s)) for k, (n, own) in found.items() for i, s in enumerate(own)]
            found.clear()
            return put(dim=pa.array([x[0] for x in rows], pa.int32()), pos=pa.array([x[1] for x in rows], pa.int32()), n=pa.array([x[2] for x in rows], pa.int64()), total=pa.array([x[3] for x in rows], pa.decimal128(38, 0)))

        for batch in pieces(batches, 4096):
            for k in [dim] if dim else lengths(batch, "v"):
                rows, x = whole(batch, "v", k)
                if rows.num_rows:
                    own = found.setdefault(k, [0, [0] * k])
                    own[0] += rows.num_rows
                    own[1] = [a + b for a, b in zip(own[1], (scaled(x, FACTOR, MOST) + SHIFT).sum(axis=0).tolist(), strict=True)]
            if sum(found) > STEP_NUMBERS:  # many lengths: their sums meet in Spark
                yield out()
        if found:
            yield out()

    parts = vectors.mapInArrow(run, "dim int, pos int, n long, total decimal(38,0)")
    by_place = table(parts.groupBy("dim", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "sums")
    commonest = by_place.where("pos = 0").orderBy(F.desc("n"), F.desc("dim")).first()
    if commonest is None:
        return None
    own = by_place.where(F.col("dim") == commonest["dim"]).orderBy("pos").collect()  # a row for each dimension
    drop(by_place)
    return Fit(commonest["dim"], commonest["n"], [int(x["total"]) for x in own])


def triangle(vectors: DataFrame, fit: Fit) -> np.ndarray:
    """The triangular factor of all centred rows."""
    dim = fit.dim

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in pieces(batches, max(dim, STEP_NUMBERS // dim)):
            rows, x = whole(batch, "v", dim)
            if rows.num_rows:
                z = fit.centred(x)
                r = np.linalg.qr(z if r is None else np.vstack([r, z]), mode="r")
        if r is not None:
            yield put(node=pa.array([TaskContext.get().partitionId()], pa.int64()), r=pa.array([r.tobytes()], pa.binary()))

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        stack = np.vstack([np.frombuffer(x, np.float64).reshape(-1, dim) for x in group.sort_values("node")["r"]])
        return pd.DataFrame({"node": [int(group["node"].iloc[0]) // SIXTEEN], "r": [np.linalg.qr(stack, mode="r").tobytes()]})

    level = table(vectors.mapInArrow(local, "node long, r binary"), "triangles")
    while level.count() > 1:
        up = table(level.groupBy(F.floor(F.col("node") / SIXTEEN)).applyInPandas(merged, "node long, r binary"), "triangles")
        drop(level)
        level = up
    r = np.frombuffer(level.first()["r"], np.float64).reshape(-1, dim)
    drop(level)
    return r


def fitted(vectors: DataFrame, dim: int | None, components: int) -> Fit | None:
    fit = sums(vectors, dim)
    if fit is not None:
        _, values, right = np.linalg.svd(triangle(vectors, fit), full_matrices=True)
        variances = np.zeros(fit.dim)
        variances[: len(values)] = values**2 / fit.n
        right = right * np.where(right[np.arange(fit.dim), np.abs(right).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]  # the largest entry is positive
        fit.total, keep = float(variances.sum()), min(components, fit.dim)
        fit.directions, fit.variances = np.ascontiguousarray(right[:keep].T), variances[:keep]
    return fit


def identity_error(vectors: DataFrame, fit: Fit) -> float | None:
    """The largest entry of the whitened rows' covariance minus the identity, over all rows."""
    dim, own = fit.dim, fit.real
    if not own:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((own + 1, own))
        for batch in pieces(batches, max(1, STEP_NUMBERS // dim)):
            rows, x = whole(batch, "v", dim)
            w = fit.whitened(x)
            total += np.vstack([w.T @ w, w.sum(axis=0)])
        yield put(pos=pa.array(range(total.size), pa.int32()), value=pa.array(total.ravel()))

    found = {x["pos"]: x["value"] for x in vectors.mapInArrow(run, "pos int, value double").groupBy("pos").agg(F.sum("value").alias("value")).collect()}
    total = np.array([found[k] for k in range((own + 1) * own)]).reshape(own + 1, own) / fit.n
    return float(np.abs(total[:own] - np.outer(total[own], total[own]) - np.eye(own)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int | None = None, components: int = COMPONENTS) -> DataFrame:
    """For each vector that counts and each component: vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error."""
    vectors = df.select(df[id_col].alias("vec_id"), df[vector_col].cast("array<double>").alias("v"))
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    fit = fitted(vectors, dim, components)
    if fit is None:
        return df.sparkSession.createDataFrame([], schema)
    error, many, own = identity_error(vectors, fit), len(fit.variances), fit.real
    explained = pa.array([float(e) / fit.total if fit.total else None for e in fit.variances], pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, max(1, STEP_NUMBERS // (4 * fit.dim))):
            rows, x = whole(batch, "v", fit.dim)
            n = rows.num_rows
            if not n:
                continue
            each = np.repeat(np.arange(n), many)
            values = np.full((n, many), np.nan)
            values[:, :own] = fit.whitened(x)
            yield put(
                vec_id=rows.column("vec_id").take(pa.array(each)), component=pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), n)), n=pa.array(np.full(n * many, fit.n, np.int64)),
                deviation=pa.array(map(Decimal, fit.deviations(x)), pa.decimal128(38, 0)).take(pa.array(each)), whitened=pa.array(values.ravel(), from_pandas=True),
                explained=explained.take(pa.array(np.tile(np.arange(many), n))), identity_error=pa.array([error] * (n * many), pa.float64()),
            )

    return vectors.mapInArrow(run, schema)
