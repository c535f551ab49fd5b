"""Helpers that the operators on embedding tables share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complete(vector: str) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    value = lambda c: c.cast("double")
    finite = lambda c: c.isNotNull() & ~F.isnan(value(c)) & (F.abs(value(c)) < float("inf"))
    return F.coalesce(F.forall(F.col(vector), finite), F.lit(False))


def dimensions(rows: DataFrame, vector: str) -> int:
    """Entries of the longest vector; 0 if there is none."""
    return rows.agg(F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("d")).first()["d"]


def as_matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a batch as rows of doubles; a shorter one is filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == dims).all():
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims))
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def scaled(matrix: np.ndarray, scale: int, most: int) -> np.ndarray:
    """floor(scale * x) as whole numbers, kept within ``most`` in size."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * matrix), -most, most).astype(np.int64)


def column_sums(rows: DataFrame, vector: str, dims: int, scale: int, most: int) -> tuple[int, list[int], list[float]]:
    """Number of rows, and per dimension the exact sum and the sum of squares of the scaled entries.

    Each task adds up its rows and passes on one number per dimension, so the driver gets as many numbers as there are dimensions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, [0] * dims, np.zeros(dims)
        for batch in batches:
            x = scaled(as_matrix(batch.column(0), dims), scale, most)
            n += len(x)
            # Halves keep the batch's sums within a long whatever the entries are.
            high, low = x >> 32, x & 0xFFFFFFFF
            sums = [s + (int(h) << 32) + int(v) for s, h, v in zip(sums, high.sum(axis=0), low.sum(axis=0), strict=True)]
            squares += (x.astype(float) ** 2).sum(axis=0)
        yield pa.RecordBatch.from_pydict(
            {"pos": list(range(-1, dims)), "total": [str(v) for v in (n, *sums)], "squares": [0.0, *squares]}
        )

    parts = rows.select(vector).mapInArrow(run, "pos long, total string, squares double")
    totals = parts.groupBy("pos").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("squares").alias("squares"))
    by = {r["pos"]: (int(r["total"]), r["squares"]) for r in totals.collect()}
    if not by:
        return 0, [0] * dims, [0.0] * dims
    return by[-1][0], [by[i][0] for i in range(dims)], [by[i][1] for i in range(dims)]
