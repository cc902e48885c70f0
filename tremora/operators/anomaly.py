"""Anomaly scores of machines by their own history: Mahalanobis distance, and its percentile in the history."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.operators.ranks import running, settled, with_group
from tremora.session import cut

#: Machines whose sums a task holds before it gives them out.
HELD = 4096


def moments(rows: DataFrame, machine: str, x: str) -> DataFrame:
    """(machine, m): the second-moment matrix of (x, 1) of each machine, row after row.

    Tasks add up matrices by machine before anything is shuffled, so a machine with any share of the rows sends one
    matrix a task. Null vectors and those that hold a null or no finite number don't count.
    """
    kind = rows.schema[machine].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            size = [m.size for m in held.values()]
            return pa.record_batch(
                [
                    pa.array(np.repeat(np.array(list(held), dtype=object), size).tolist(), batch_type),
                    pa.array(np.concatenate([np.arange(n) for n in size] or [np.zeros(0, int)]), pa.int32()),
                    pa.array(np.concatenate([m.ravel() for m in held.values()] or [np.zeros(0)]), pa.float64())
                ],
                names=["machine", "i", "v"]
            )

        batch_type = None
        for batch in batches:
            batch_type = batch.schema.field(0).type
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            x = np.column_stack([x, np.ones(len(x))])
            code = coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            starts = np.searchsorted(code[order], np.arange(len(coded.dictionary)))
            for name, part in zip(coded.dictionary.to_pylist(), np.split(x[order], starts[1:]), strict=True):
                own = part.T @ part
                held[name] = own if name not in held else held[name] + own
            if len(held) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    own = rows.select(F.col(machine).alias("machine"), F.col(x).alias("x")).where(F.col(machine).isNotNull())
    whole = own.where(F.coalesce(F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))), F.lit(False)))
    parts = whole.mapInArrow(partial, f"machine {kind}, i int, v double")
    sums = parts.groupBy("machine", "i").agg(F.sum("v").alias("v"))
    return sums.groupBy("machine").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("m")
    )


def whitening(matrix: np.ndarray) -> np.ndarray | None:
    """Mean and whitening matrix from second moments, by Cholesky; None if the history is too short or flat."""
    n, d = matrix[-1, -1], len(matrix) - 1
    if n <= d + 1:
        return None
    mean = matrix[-1, :-1] / n
    spread = matrix[:-1, :-1] / n - np.outer(mean, mean)
    size = np.sqrt(np.maximum(np.diag(spread), 0))
    if (size <= 1e-9 * np.sqrt(np.maximum(np.diag(matrix)[:-1] / n, 1e-300))).any():
        return None
    scaled = spread / np.outer(size, size)
    if np.linalg.eigvalsh(scaled)[0] < 1e-9:
        return None
    inverse = np.linalg.inv(np.linalg.cholesky(scaled))
    return np.concatenate([mean, (inverse / size).ravel()])


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _model(column: pa.Array) -> pa.Array:
    out = []
    for m in column:
        flat = m.values.to_numpy(zero_copy_only=False)
        d = int(round(len(flat) ** 0.5))
        out.append(whitening(flat.reshape(d, d)))
    return pa.array(out, pa.list_(pa.float64()))


@F.arrow_udf(T.DoubleType())
def _distance(x: pa.Array, model: pa.Array) -> pa.Array:
    out = np.full(len(x), np.nan)
    known = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False) & model.is_valid().to_numpy(zero_copy_only=False))
    if len(known):
        values = x.take(pa.array(known)).flatten().to_numpy(zero_copy_only=False).reshape(len(known), -1)
        parts = model.take(pa.array(known)).flatten().to_numpy(zero_copy_only=False).reshape(len(known), -1)
        d = values.shape[1]
        centred = values - parts[:, :d]
        out[known] = np.linalg.norm(np.einsum("nij,nj->ni", parts[:, d:].reshape(-1, d, d), centred), axis=1)
    return pa.array(out, mask=np.isnan(out))


def scored(rows: DataFrame, machine: str, key: str, x: str) -> DataFrame:
    """(key, machine, score, percentile): the distance of each vector from its machine's history, and the share of
    that history with a score no greater. Null for machines whose history is too short or flat, and for vectors that
    are not whole.
    """
    model = settled(moments(rows, machine, x).select("machine", _model("m").alias("model")))
    finite = F.coalesce(F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))), F.lit(False))
    own = rows.select(F.col(key).alias("key"), F.col(machine).alias("machine"), F.when(finite, F.col(x)).alias("x"))
    found = cut(
        with_group(own, model, ["machine"], "left").select("key", "machine", F.round(_distance("x", "model"), 6).alias("score")),
        "scores"
    )
    levels = found.where("score is not null").groupBy("machine", "score").agg(F.count("*").alias("c"))
    ranked = running(levels, ["machine"], "score", "c")
    totals = levels.groupBy("machine").agg(F.sum("c").alias("n"))
    shares = ranked.join(totals, "machine").select(
        F.col("machine").alias("__m"), F.col("score").alias("__score"), ((F.col("__before") + F.col("c")) / F.col("n")).alias("percentile")
    )
    same = F.col("machine").eqNullSafe(F.col("__m")) & (F.col("score") == F.col("__score"))
    return found.join(shares, same, "left").select("key", "machine", "score", "percentile")
