"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of whole texts are standardised and mapped to cosines whose inner products approximate a
Gaussian kernel. Each partition sums its share of the normal equations, rows of the matrix are summed
across partitions by row number, and the driver solves a system of fixed size. Part of the learning rows
is left out of the fit and calibrates the scores by isotonic regression over a histogram.

Defined results: a null text is empty; labels that are null are not learned from; a label row without
document counts for nothing. Without labelled rows every score is 0.5. Scores never depend on
labels, language, source or key. Repeated rows get equal scores. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.llm.statistics import FEATURES, features
from tremora.llm.textscan import array_slices
from tremora.session import cut

COSINES = 192
RIDGE = 1e-3
SEED = 20240229
BINS = 2000
THRESHOLD = 0.7


@F.arrow_udf(T.ArrayType(T.FloatType()))
def statistics(column: pa.Array) -> pa.Array:
    """The statistics of each text, in the order of FEATURES."""
    parts = []
    for part in array_slices(column):
        values = features(part).astype(np.float32)
        parts.append(
            pa.ListArray.from_arrays(
                pa.array(np.arange(len(part) + 1, dtype=np.int32) * len(FEATURES)), pa.array(values.ravel())
            )
        )
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES)).astype(float)


@dataclass
class Classifier:
    mean: np.ndarray
    deviation: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -6, 6)
        out = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.frequencies + self.phases)
        return np.hstack([out, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; a slight slope within flat steps keeps the order of the raw scores."""
        if not len(self.knots):
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        level = np.interp(raw, self.knots, self.levels)
        return 0.99 * level + 0.01 / (1 + np.exp(-4 * (raw - 0.5)))


def _frequencies(d: int, cosines: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(0, 1 / width, (d, cosines)), rng.uniform(0, 2 * np.pi, cosines)


def normal_equations(rows: DataFrame, model: Classifier) -> tuple[np.ndarray, np.ndarray]:
    """Sums of outer products of the features, and of features times labels, over (x, y)."""
    size = len(model.phases) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                c = model.cosines(_matrix(part.column(0)))
                total += c.T @ np.hstack([c, part.column(1).to_numpy(zero_copy_only=False).astype(float)[:, None]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size, dtype=np.int32)), pa.array([r.tobytes() for r in total], pa.binary())],
            names=["i", "v"]
        )

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
            names=["i", "v"]
        )

    found = rows.select("x", "y").mapInArrow(
        partial, "i int, v binary"
    ).repartition("i").mapInArrow(summed, "i int, v binary").collect()
    out = np.zeros((size, size + 1))
    for r in found:
        out[r["i"]] = np.frombuffer(r["v"])
    return out[:, :-1], out[:, -1]


def isotonic(weight: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``mean`` in weighted squares, by pooling adjacent violators."""
    blocks: list[list[float]] = []  # mean, weight, length
    for m, w in zip(mean, weight, strict=True):
        blocks.append([m, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m1, w1, n1 = blocks.pop()
            m0, w0, n0 = blocks.pop()
            blocks.append([(m0 * w0 + m1 * w1) / (w0 + w1), w0 + w1, n0 + n1])
    return np.concatenate([np.full(n, m) for m, _, n in blocks]) if blocks else np.zeros(0)


def fit(rows: DataFrame, cosines: int = COSINES, ridge: float = RIDGE, seed: int = SEED) -> Classifier:
    """Learn from rows (x statistics, y 0 or 1, calibrate boolean)."""
    d = len(FEATURES)
    moments = rows.where(~F.col("calibrate")).agg(
        F.count("*").alias("n"),
        *(f(F.col("x")[i]).alias(f"{n}{i}") for i in range(d) for n, f in (("m", F.mean), ("s", F.stddev_pop)))
    ).first()
    frequencies, phases = _frequencies(d, cosines, np.sqrt(d), seed)
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(d)])
    deviation = np.array([moments[f"s{i}"] or 1.0 for i in range(d)])
    model = Classifier(
        mean, np.maximum(deviation, 1e-6), frequencies, phases, np.zeros(cosines + 1), np.zeros(0), np.zeros(0)
    )
    n = moments["n"]
    if not n:
        return model
    a, b = normal_equations(rows.where(~F.col("calibrate")), model)
    model.weights = np.linalg.solve(a + ridge * n * np.diag([*[1.0] * cosines, 1e-6]), b)

    @F.arrow_udf(T.DoubleType())
    def raw(column: pa.Array) -> pa.Array:
        return pa.array(model.raw(_matrix(column)))

    bin_ = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), raw("x"))) * BINS).cast("int")
    steps = rows.where("calibrate").groupBy(bin_.alias("b")).agg(
        F.count("*").alias("n"), F.mean(F.col("y").cast("double")).alias("m")
    ).collect()  # 3 * BINS + 1 at most
    steps.sort(key=lambda r: r["b"])
    if steps:
        model.knots = np.array([r["b"] for r in steps]) / BINS
        model.levels = isotonic(np.array([r["n"] for r in steps], float), np.array([r["m"] for r in steps]))
    else:
        model.knots, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def scored(docs: DataFrame, model: Classifier, x: str = "x") -> Column:
    @F.arrow_udf(T.DoubleType())
    def score(column: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(column)), pa.float64())

    return score(F.col(x))


def remainder(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 4


def classify(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    held: int = 2,
    calibrate: int = 3
) -> DataFrame:
    """(key, held_out, score) of every row. Rows of remainder ``held`` are not learned from."""
    found = cut(
        docs.select(F.col(key).alias("__key"), statistics(F.coalesce(F.col(text), F.lit(""))).alias("x")), "statistics"
    )
    known = labels.select(F.col(key).alias("__key"), F.col(label).alias("y")).where(
        F.col("y").isNotNull() & (remainder(F.col("__key")) != held)
    )
    rows = cut(
        found.join(known, "__key").select("x", "y", (remainder(F.col("__key")) == calibrate).alias("calibrate")),
        "learned"
    )
    model = fit(rows)
    return found.select(
        F.col("__key").alias(key),
        F.coalesce(remainder(F.col("__key")) == held, F.lit(False)).alias("held_out"),
        scored(found, model).alias("score")
    )


def op4_quality_classifier(spark, sf_dir):
    """Scores of every text of ``documents``, learned from ``labels``."""
    from tremora.session import table

    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
