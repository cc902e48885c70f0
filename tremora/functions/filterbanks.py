"""Filter-bank trees over waveforms: wavelet packets, the kurtogram, and continuous wavelet scalograms.

Trees run over Arrow batches, all waveforms of one length as one matrix: a level is one product with the filters of
every node, whatever the number of waveforms. Waveforms that are null or empty give null; those whose length a tree's
depth doesn't divide are filled up with zeros.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.functions.dsp import _each

#: Oscillations of the Morlet wavelet within its envelope, as the usual angular frequency.
MORLET = 6.0


def daubechies(moments: int) -> np.ndarray:
    """The low-pass filter of the orthogonal wavelet with so many vanishing moments, by spectral factorisation."""
    half = [math.comb(moments - 1 + k, k) for k in range(moments)]
    # roots in y = (2 - z - 1/z) / 4, each a pair in z of which the one inside the unit circle is kept
    taps = np.array([1.0])
    for y in np.roots(half[::-1]):
        pair = np.roots([1.0, 4.0 * y - 2.0, 1.0])
        taps = np.convolve(taps, [1.0, -pair[np.argmin(np.abs(pair))]])
    for _ in range(moments):
        taps = np.convolve(taps, [1.0, 1.0])
    taps = np.real(taps)
    return taps * math.sqrt(2.0) / taps.sum()


def filter_pair(moments: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) filters of two orthogonal channels."""
    low = daubechies(moments)
    return low, low[::-1] * (-1.0) ** np.arange(len(low))


def _filled(x: np.ndarray, step: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % step)))


def packet_levels(x: np.ndarray, depth: int, moments: int) -> list[np.ndarray]:
    """Coefficients of every level: (waveforms, nodes in order of frequency, coefficients). Signals go round.

    A high branch turns the order of the frequencies of what lies below it, so its children change places.
    """
    filters = np.array(filter_pair(moments))
    nodes, levels = _filled(x, 1 << depth)[:, None, :], []
    for _ in range(depth):
        rows, count, n = nodes.shape
        at = (2 * np.arange(n // 2)[:, None] + np.arange(filters.shape[1])) % n
        children = np.einsum("rckj,bj->rcbk", nodes[:, :, at], filters)
        children[:, 1::2] = children[:, 1::2, ::-1]
        nodes = children.reshape(rows, 2 * count, n // 2)
        levels.append(nodes)
    return levels


def packet_signal(nodes: np.ndarray, moments: int) -> np.ndarray:
    """The waveforms whose last level this is."""
    filters = np.array(filter_pair(moments))
    while nodes.shape[1] > 1:
        rows, count, half = nodes.shape
        pairs = nodes.reshape(rows, count // 2, 2, half).copy()
        pairs[:, 1::2] = pairs[:, 1::2, ::-1]
        out = np.zeros((rows, count // 2, 2 * half))
        for j in range(filters.shape[1]):
            at = (2 * np.arange(half) + j) % (2 * half)
            np.add.at(out, (slice(None), slice(None), at), np.einsum("rcbk,b->rck", pairs, filters[:, j]))
        nodes = out
    return nodes[:, 0]


def packet_energies(depth: int = 4, moments: int = 2):
    """Energies of all nodes of levels 1 to ``depth``, level after level, by frequency within a level."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(column: pa.Array) -> pa.Array:
        return _each(
            column,
            lambda x: np.concatenate([(c * c).sum(axis=2) for c in packet_levels(x, depth, moments)], axis=1)
        )

    return run


def best_basis(depth: int = 4, moments: int = 2):
    """Numbers, as in ``packet_energies``, of the nodes whose coefficients together have the least entropy."""

    def costs(x: np.ndarray) -> np.ndarray:
        total = np.maximum((x * x).sum(axis=1), 1e-300)[:, None, None]
        levels = packet_levels(x, depth, moments)
        cost = []
        for c in levels:
            share = c * c / total
            cost.append(-(share * np.log(np.maximum(share, 1e-300))).sum(axis=2))
        chosen, best = [np.ones_like(cost[-1], dtype=bool)], cost[-1]
        for own in cost[-2::-1]:
            below = best.reshape(len(x), -1, 2).sum(axis=2)
            keep = own <= below
            best = np.where(keep, own, below)
            for i, c in enumerate(chosen):  # what lies under a kept node is not chosen
                chosen[i] = c & ~np.repeat(keep, c.shape[1] // keep.shape[1], axis=1)
            chosen.insert(0, keep)
        flags = np.concatenate(chosen, axis=1)
        return [np.flatnonzero(row).astype(float) for row in flags]

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(column: pa.Array) -> pa.Array:
        return _each(column, costs)

    return run


# -- kurtogram ---------------------------------------------------------------------------------------

TAPS = 16
#: Samples that a node must have for its kurtosis to say anything.
LEAST_SAMPLES = 8


def split_filters(parts: int) -> np.ndarray:
    """Complex filters that cut the positive frequencies of a signal into equal parts."""
    at = np.arange(TAPS) - (TAPS - 1) / 2
    low = np.sinc(at / (2 * parts)) / (2 * parts) * np.hamming(TAPS)
    low /= low.sum()
    return np.array([low * np.exp(1j * np.pi * (2 * k + 1) / (2 * parts) * at) for k in range(parts)])


def _split(nodes: np.ndarray, parts: int) -> np.ndarray:
    """Children of all nodes by frequency: filtered, every ``parts``-th sample, odd parts turned round to start at 0."""
    rows, count, n = nodes.shape
    wide = np.pad(nodes, ((0, 0), (0, 0), (TAPS // 2 - 1, TAPS // 2)))
    at = parts * np.arange(n // parts)[:, None] + np.arange(TAPS)
    children = np.einsum("rckj,bj->rcbk", wide[:, :, at], split_filters(parts))
    children[:, :, 1::2] *= (-1.0) ** np.arange(n // parts)
    return children.reshape(rows, parts * count, n // parts)


def kurtogram_nodes(n: int, depth: int) -> list[tuple[float, int]]:
    """(level, band) of every node of a tree over n samples. Levels 1.6, 2.6 ... are cut in three below 0, 1 ..."""
    found = [(0.0, 0)]
    for level in range(1, depth + 1):
        if n >> level >= LEAST_SAMPLES:
            found += [(float(level), b) for b in range(1 << level)]
        if (n >> (level - 1)) // 3 >= LEAST_SAMPLES:
            found += [(level + 0.6, b) for b in range(3 << (level - 1))]
    return found


def band_kurtosis(x: np.ndarray, depth: int) -> np.ndarray:
    """Kurtosis of the complex envelope in every node, in the order of ``kurtogram_nodes``; 0 in empty bands."""

    def of(nodes: np.ndarray) -> np.ndarray:
        power = np.abs(nodes) ** 2
        mean = power.mean(axis=2)
        return np.where(mean > 1e-300, (power**2).mean(axis=2) / np.maximum(mean, 1e-300) ** 2 - 2, 0.0)

    n = x.shape[1]
    centred = x - x.mean(axis=1, keepdims=True)
    power = (centred**2).mean(axis=1)
    whole = np.where(power > 1e-300, (centred**4).mean(axis=1) / np.maximum(power, 1e-300) ** 2 - 3, 0.0)
    found, nodes = [whole[:, None]], centred[:, None, :]
    for level in range(1, depth + 1):
        if (n >> (level - 1)) // 3 >= LEAST_SAMPLES:
            thirds = of(_split(nodes, 3))
        else:
            thirds = np.zeros((len(x), 0))
        if n >> level < LEAST_SAMPLES:
            found.append(thirds)
            break
        nodes = _split(nodes, 2)
        found += [of(nodes), thirds]
    return np.concatenate(found, axis=1)


def kurtogram(depth: int):
    """(level, band, kurtosis) of every node of each waveform's tree."""
    row = T.StructType(
        [
            T.StructField("level", T.DoubleType()),
            T.StructField("band", T.IntegerType()),
            T.StructField("kurtosis", T.DoubleType())
        ]
    )

    @F.arrow_udf(T.ArrayType(row))
    def run(column: pa.Array) -> pa.Array:
        values = _each(column, lambda x: band_kurtosis(x, depth))
        sizes = pc.list_value_length(column).fill_null(0).to_pylist()
        nodes = {n: kurtogram_nodes(n, depth) for n in set(sizes) if n}
        each = [nodes[n] if n else [] for n in sizes]
        structs = pa.StructArray.from_arrays(
            [
                pa.array([level for of in each for level, _ in of], pa.float64()),
                pa.array([band for of in each for _, band in of], pa.int32()),
                values.flatten()
            ],
            names=["level", "band", "kurtosis"]
        )
        offsets = np.concatenate([[0], np.cumsum([len(of) for of in each])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), structs, mask=pa.array([not n for n in sizes], pa.bool_()))

    return run


# -- continuous wavelets -----------------------------------------------------------------------------


def morlet(n: int, scale: float) -> np.ndarray:
    """The wavelet at a scale in samples, around sample 0 of a round signal of n."""
    at = (np.arange(n) + n // 2) % n - n // 2
    return np.exp(-0.5 * (at / scale) ** 2 + 1j * MORLET * at / scale) / math.sqrt(scale)


def wavelet_transform(x: np.ndarray, scales: list[float]) -> np.ndarray:
    """(waveforms, scales, samples): complex coefficients, all scales by one transform of each waveform."""
    n = x.shape[1]
    bank = np.conj(np.fft.fft(np.array([morlet(n, s) for s in scales]), axis=1))
    return np.fft.ifft(np.fft.fft(x, axis=1)[:, None, :] * bank, axis=2)


def scalogram(scales: list[float]):
    """For each scale the energy of the coefficients and the largest of them: two numbers a scale."""

    def all_rows(x: np.ndarray) -> np.ndarray:
        size = np.abs(wavelet_transform(x, scales))
        return np.stack([(size**2).sum(axis=2), size.max(axis=2)], axis=2).reshape(len(x), -1)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(column: pa.Array) -> pa.Array:
        return _each(column, all_rows)

    return run
