"""Signals in arrays: windows, single-frequency transforms and markers as columns; whole spectra in Arrow batches.

Sample i of an array of n is x[i], 0 based. Frequencies above half the sampling rate are refused (null).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def array_rms(x: Column) -> Column:
    return F.sqrt(total(F.transform(x, lambda v: v.cast("double") * v)) / F.size(x))


def array_mean(x: Column) -> Column:
    return total(doubles(x)) / F.size(x)


def array_peak(x: Column) -> Column:
    return F.array_max(F.transform(x, lambda v: F.abs(v.cast("double"))))


def central_moment(x: Column, mean: Column, k: int) -> Column:
    return total(F.transform(x, lambda v: F.pow(v.cast("double") - mean, F.lit(float(k))))) / F.size(x)


def hann(x: Column) -> Column:
    """Periodic Hann window applied to the samples."""
    n = F.size(x)
    return F.transform(x, lambda v, i: v.cast("double") * 0.5 * (1 - F.cos(2 * math.pi * i / n)))


def bin_power(x: Column, k: Column) -> Column:
    """Squared magnitude of the transform at (possibly fractional) bin k."""
    n = F.size(x)
    re = total(F.transform(x, lambda v, i: v.cast("double") * F.cos(2 * math.pi * k * i / n)))
    im = total(F.transform(x, lambda v, i: v.cast("double") * F.sin(2 * math.pi * k * i / n)))
    return re * re + im * im


def amplitude(x: Column, k: Column, gain: float = 1.0) -> Column:
    """Amplitude at bin k: 2|X| / (n gain); null above half of the samples."""
    return F.when(k <= F.size(x) / 2, 2 * F.sqrt(bin_power(x, k)) / F.size(x) / gain)


def at_frequency(x: Column, frequency: Column, rate: Column) -> Column:
    return amplitude(x, frequency * F.size(x) / rate)


def decibels(ratio: Column) -> Column:
    return F.when(ratio > 0, 20 * F.log10(ratio))


def bearing_frequencies(
    rpm: Column, balls: Column, ball: Column, pitch: Column, contact_deg: Column
) -> dict[str, Column]:
    """Cage, outer-race, inner-race and ball-spin frequencies in Hz."""
    fr = rpm / 60
    g = ball / pitch * F.cos(F.radians(contact_deg))
    return {
        "ftf": fr / 2 * (1 - g),
        "bpfo": balls * fr / 2 * (1 - g),
        "bpfi": balls * fr / 2 * (1 + g),
        "bsf": pitch / (2 * ball) * fr * (1 - g * g)
    }


def sidebands(supply: Column, slip: Column) -> tuple[Column, Column]:
    return supply - 2 * slip * supply, supply + 2 * slip * supply


def gear_mesh(rpm: Column, teeth: Column, rate: Column) -> Column:
    """Teeth times shaft frequency; null below a sampling rate of 10 kHz."""
    return F.when(rate >= 10_000, teeth * rpm / 60)


# -- whole spectra -----------------------------------------------------------------------------------


def _each(column: pa.Array, f) -> pa.Array:
    """Apply f to the rows of a list array, all rows of one length as one matrix; null for rows that are null or
    empty.
    """
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    out: list[np.ndarray | None] = [None] * len(column)
    for n in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == n)
        matrix = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), n)
        for i, row in zip(at.tolist(), f(matrix), strict=True):
            out[i] = row
    return pa.array(out, pa.list_(pa.float64()))


def _spectrum(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    amplitudes = np.abs(np.fft.rfft(x, axis=1)) / n
    amplitudes[:, 1 : (n + 1) // 2] *= 2
    return amplitudes


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def rfft(column: pa.Array) -> pa.Array:
    """Amplitude of each bin from 0 to n/2; rows of any length, each a power of two or not."""
    return _each(column, _spectrum)


def band_taps(low: float, high: float, rate: float, taps: int = 31) -> np.ndarray:
    """A windowed sinc band-pass. Bands above half the sampling rate are refused."""
    if not 0 <= low < high <= rate / 2:
        raise ValueError(f"a band of {low} to {high} Hz needs a sampling rate of {2 * high} at least, not {rate}")
    at = np.arange(taps) - (taps - 1) / 2
    return (
        2 * high / rate * np.sinc(2 * high / rate * at) - 2 * low / rate * np.sinc(2 * low / rate * at)
    ) * np.hamming(taps)


def filtered(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Rows convolved with centred taps, same length."""
    half = (len(taps) - 1) // 2
    wide = np.pad(x, ((0, 0), (len(taps) - 1 - half, half)))
    n = x.shape[1]
    return sum(h * wide[:, len(taps) - 1 - j : len(taps) - 1 - j + n] for j, h in enumerate(taps))


def band_filter(low: float, high: float, rate: float, taps: int = 31):
    """FIR band-pass of windowed sinc taps, centred, same length."""
    h = band_taps(low, high, rate, taps)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(column: pa.Array) -> pa.Array:
        return _each(column, lambda x: filtered(x, h))

    return run


def decimated(factor: int, taps: int = 63):
    """Every factor-th sample behind an anti-alias low-pass at half the new rate."""
    h = band_taps(0.0, 0.5 / factor, 1.0, taps)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(column: pa.Array) -> pa.Array:
        return _each(column, lambda x: filtered(x, h / h.sum())[:, ::factor])

    return run


def low_pass(cutoff: float, rate: float, taps: int = 31) -> np.ndarray:
    """Low-pass taps that keep a constant as it is."""
    h = band_taps(0.0, cutoff, rate, taps)
    return h / h.sum()


def envelope(low: float, high: float, rate: float, cutoff: float):
    """Band-pass, rectify, low-pass, then the spectrum without its mean."""
    h, g = band_taps(low, high, rate), low_pass(cutoff, rate)

    def all_rows(x: np.ndarray) -> np.ndarray:
        level = filtered(np.abs(filtered(x, h)), g)
        return _spectrum(level - level.mean(axis=1, keepdims=True))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(column: pa.Array) -> pa.Array:
        return _each(column, all_rows)

    return run


def order_resample(points: int):
    """Samples at equal steps of shaft angle, from samples in time and the angle (in turns) at each; null where either
    is null or empty, their lengths differ or the shaft doesn't turn. All rows of one length are interpolated at once.
    """

    def even(x: np.ndarray, turns: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        span = turns[:, -1:] - turns[:, :1]
        # each row on a stretch of its own
        own = (turns - turns[:, :1]) / np.where(span > 0, span, np.nan) + 2 * rows
        at = np.linspace(0, 1, points) + 2 * rows
        return np.where(span > 0, np.interp(at.ravel(), own.ravel(), x.ravel()).reshape(at.shape), np.nan)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(column: pa.Array, turns: pa.Array) -> pa.Array:
        sizes, other = (
            pc.list_value_length(c).fill_null(0).to_numpy(zero_copy_only=False) for c in (column, turns)
        )
        out: list[np.ndarray | None] = [None] * len(column)
        for n in np.unique(sizes[(sizes > 0) & (sizes == other)]):
            at = pa.array(np.flatnonzero((sizes == n) & (other == n)))
            x, angle = (
                c.take(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n) for c in (column, turns)
            )
            for i, row in zip(at.to_pylist(), even(x, angle), strict=True):
                out[i] = None if np.isnan(row[0]) else row
        return pa.array(out, pa.list_(pa.float64()))

    return run
