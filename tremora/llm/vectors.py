"""What the operators on embedding vectors share: integer components in matrices, and exact sums by group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components are held within this, so that squared distances of 64 components fit a long.
LARGEST = 1 << 27
#: Products of matrices are exact in doubles as long as no component is beyond this.
EXACT = 1 << 20
#: Squared distances up to this are summed as longs, thousands at a time.
SMALL = 1 << 44


def whole(vector: Column) -> Column:
    """Whether a vector is neither null nor holds null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component x as a double."""
    x = lambda v: F.floor(F.least(F.greatest(v.cast("double") * scale, F.lit(-LARGEST)), F.lit(LARGEST)))
    return F.transform(vector, lambda v: x(v).cast("int"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length as int64."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer a @ b.T; in doubles, which are faster, wherever these hold every partial sum."""
    most = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if most <= EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def partial_sums(group: np.ndarray, groups: int, square: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``group_sums`` of squared distances and components."""
    both = np.column_stack([square, rows])
    return group_sums(group, groups, both.astype(object) if square.max(initial=0) > SMALL else both)


def group_sums(group: np.ndarray, groups: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of each group, componentwise sums of each group), exact; rows of large numbers come as Python integers."""
    order = np.argsort(group, kind="stable")
    counts = np.bincount(group, minlength=groups)
    total = np.zeros((groups, rows.shape[1]), dtype=rows.dtype)
    held = np.flatnonzero(counts)
    if len(held):
        total[held] = np.add.reduceat(rows[order], (np.cumsum(counts) - counts)[held], axis=0)
    return counts, total


def summed(parts: DataFrame, keys: list[str], width: int) -> dict[tuple, tuple[int, list[int]]]:
    """(count, sums) of each group over the partial sums of all tasks. The caller's groups are of fixed number."""
    sums = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    rows = parts.groupBy(*keys).agg(F.sum("n").alias("n"), *sums).collect()
    return {tuple(r[k] for k in keys): (r["n"], [r[f"s{i}"] for i in range(width)]) for r in rows}
