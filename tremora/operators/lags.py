"""Correlation of series at all lags of a window, by Fourier transforms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

BEST = T.StructType([T.StructField("lag", T.IntegerType()), T.StructField("r", T.DoubleType())])


def correlations(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Normalised correlations of a[t] with b[t + lag] for lags -most to most; zeros where nothing is known."""
    n = 1 << int(np.ceil(np.log2(len(a) + most + 1)))
    product = np.fft.irfft(np.conj(np.fft.rfft(a, n)) * np.fft.rfft(b, n), n)
    size = np.sqrt((a * a).sum() * (b * b).sum())
    return product[np.arange(-most, most + 1)] / size if size > 0 else np.zeros(2 * most + 1)


def best_lag(most: int):
    """The lag within ``most`` steps of largest absolute correlation, and that correlation, of two series given as
    arrays of (at, v): centred on their own means, zero where one has no value. Ties go to the smaller lag; null if a
    series is null, empty or flat.
    """

    def grid(at: np.ndarray, v: np.ndarray, low: int, high: int) -> np.ndarray:
        out = np.zeros(high - low + 1)
        out[at - low] = v - v.mean()
        return out

    @F.arrow_udf(BEST)
    def run(one: pa.Array, other: pa.Array) -> pa.Array:
        lags, r = [], []
        for a, b in zip(one, other, strict=True):
            found = None
            if a.is_valid and b.is_valid and len(a.values) and len(b.values):
                sides = [
                    (s.values.field(0).to_numpy(), s.values.field(1).to_numpy(zero_copy_only=False)) for s in (a, b)
                ]
                low, high = min(s[0].min() for s in sides), max(s[0].max() for s in sides)
                x, y = (grid(at, v, low, high) for at, v in sides)
                if (x * x).sum() > 1e-20 and (y * y).sum() > 1e-20:
                    c = np.round(correlations(x, y, most), 9)
                    order = np.lexsort((np.arange(-most, most + 1), np.abs(np.arange(-most, most + 1)), -np.abs(c)))
                    found = int(order[0]) - most, float(c[order[0]])
            lags.append(found and found[0])
            r.append(found and found[1])
        return pa.StructArray.from_arrays(
            [pa.array(lags, pa.int32()), pa.array(r, pa.float64())],
            names=["lag", "r"],
            mask=pa.array([x is None for x in lags], pa.bool_())
        )

    return run
