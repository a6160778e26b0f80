"""What the operators on vectors share: rows of an Arrow list column as a matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Numbers that one step of a batch function works on.
STEP_NUMBERS = 500_000


def whole(batch: pa.RecordBatch, column: str, dim: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows whose vector has dim numbers, none of them null or not finite, and these vectors as a matrix of doubles."""
    batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(column)), dim), False))
    found = pc.list_flatten(batch.column(column)).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
    ok = np.isfinite(found).all(axis=1)
    return (batch, found) if ok.all() else (batch.filter(pa.array(ok)), found[ok])


def lengths(batch: pa.RecordBatch, column: str) -> list[int]:
    """The lengths that occur, null and empty vectors left out."""
    return [n for n in pc.unique(pc.list_value_length(batch.column(column))).to_pylist() if n]


def scaled(found: np.ndarray, factor: int, most: int) -> np.ndarray:
    """floor(factor * c) of each number c, exact; numbers beyond most, for which sums and squares wouldn't be, are an error."""
    out = np.floor(found * factor)
    if len(out) and np.abs(out).max() > most:
        raise ValueError(f"vectors hold numbers beyond {most / factor:g}, for which {factor} * c can't be summed exactly")
    return out.astype(np.int64)


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
