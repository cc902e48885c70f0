"""Wavelet packets, kurtograms and scalograms: identities, planted signals, odd rows."""

import numpy as np
import pytest

from tremora.functions import filterbanks as fb


@pytest.mark.parametrize("moments", [1, 2, 4, 8])
def test_filters_are_orthonormal(moments):
    low, high = fb.filter_pair(moments)
    assert len(low) == 2 * moments
    for shift in range(0, len(low), 2):
        same = 1.0 if shift == 0 else 0.0
        assert abs(low[shift:] @ low[: len(low) - shift] - same) < 1e-9
        assert abs(high[shift:] @ high[: len(high) - shift] - same) < 1e-9
        assert abs(low[shift:] @ high[: len(high) - shift]) < 1e-9
    powers = np.arange(2 * moments)
    for k in range(moments):  # the high filter sees no polynomial below its moments
        assert abs((high * powers.astype(float) ** k).sum()) < 1e-4 * max(1, (2 * moments) ** k)


@pytest.mark.parametrize("moments", [1, 2, 4])
def test_packets_keep_energy_and_lead_back(moments):
    x = np.random.default_rng(1).normal(size=(7, 96))
    levels = fb.packet_levels(x, 4, moments)
    for level, nodes in enumerate(levels, 1):
        assert nodes.shape == (7, 1 << level, 96 >> level)
        assert np.allclose((nodes**2).sum(axis=(1, 2)), (x**2).sum(axis=1), rtol=1e-9)
    assert np.allclose(fb.packet_signal(levels[-1], moments), x, atol=1e-9)


def test_nodes_stand_in_order_of_frequency():
    n, depth = 1024, 4
    for node in range(1 << depth):
        tone = np.cos(np.pi * (node + 0.5) / (1 << depth) * np.arange(n))[None]
        energy = (fb.packet_levels(tone, depth, 8)[-1] ** 2).sum(axis=2)[0]
        assert energy.argmax() == node and energy[node] > 0.5 * energy.sum()


def test_the_best_basis_covers_the_axis_once(spark):
    rng = np.random.default_rng(2)
    waves = [rng.normal(size=64).tolist(), np.cos(np.pi * 5.5 / 16 * np.arange(64)).tolist(), [0.0] * 31 + [1.0] + [0.0] * 32]
    frame = spark.createDataFrame([(i, w) for i, w in enumerate(waves)], "i int, x array<double>")
    for row in frame.select("i", fb.best_basis(4, 2)("x").alias("b")).collect():
        spans = []
        for at in map(int, row["b"]):
            level = (at + 2).bit_length() - 1
            node = at + 2 - (1 << level)
            spans.append((node / (1 << level), (node + 1) / (1 << level)))
        assert spans and sorted(spans)[0][0] == 0 and sorted(spans)[-1][1] == 1
        assert all(a[1] == b[0] for a, b in zip(sorted(spans), sorted(spans)[1:]))
        if row["i"] == 2:  # an impulse is best left in time
            assert len(spans) == 2


def test_a_planted_resonance_is_found():
    """Impulses that ring at 6.5 kHz in noise of 20 kHz sampling: the band around it has the largest kurtosis."""
    rng = np.random.default_rng(3)
    n, rate = 8192, 20_000.0
    ring = np.exp(-np.arange(200) / 25) * np.sin(2 * np.pi * 6500 / rate * np.arange(200))
    x = rng.normal(size=n) * 0.5
    for start in range(100, n - 200, 500):
        x[start : start + 200] += 3 * ring
    kurtosis, nodes = fb.band_kurtosis(x[None], 4)[0], fb.kurtogram_nodes(n, 4)
    assert len(kurtosis) == len(nodes)
    level, band = nodes[int(kurtosis.argmax())]
    bands = round(2**level) if level == int(level) else 3 * 2 ** (int(level) - 1)
    assert level > 0 and band / bands * rate / 2 <= 6500 <= (band + 1) / bands * rate / 2
    noise = fb.band_kurtosis(rng.normal(size=(1, n)), 4)[0]
    assert np.abs(noise).max() < 0.8 < kurtosis.max()
    tone = fb.band_kurtosis(np.sin(2 * np.pi * 3000 / rate * np.arange(n))[None], 2)[0]
    assert tone[1] < -0.8  # a steady tone has an even envelope


def test_the_transform_equals_its_sums_and_finds_a_tone():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2, 50))
    got = fb.wavelet_transform(x, [2.0, 5.0])
    for r in range(2):
        for i, s in enumerate((2.0, 5.0)):
            for b in (0, 17, 49):
                want = sum(x[r, t] * np.conj(fb.morlet(50, s)[(t - b) % 50]) for t in range(50))
                assert abs(got[r, i, b] - want) < 1e-9
    scales = [4.0, 8.0, 16.0, 32.0]
    for i, s in enumerate(scales):
        tone = np.cos(fb.MORLET / s * np.arange(1024))[None]
        assert (np.abs(fb.wavelet_transform(tone, scales)) ** 2).sum(axis=2)[0].argmax() == i


def test_odd_rows(spark):
    rows = [(0, None), (1, []), (2, [1.0]), (3, [1.0, 2.0, 3.0]), (4, [0.0] * 64), (5, [2.0] * 1000)]
    frame = spark.createDataFrame(rows, "i int, x array<double>")
    found = frame.select(
        "i",
        fb.packet_energies(4, 2)("x").alias("p"),
        fb.kurtogram(3)("x").alias("k"),
        fb.scalogram([2.0])("x").alias("s"),
        fb.best_basis(4, 2)("x").alias("b")
    ).collect()
    for r in found:
        if r["i"] < 2:
            assert r["p"] is None and r["k"] is None and r["s"] is None and r["b"] is None
        else:
            x = rows[r["i"]][1]
            assert abs(sum(r["p"][:2]) - sum(v * v for v in x)) < 1e-6 and len(r["p"]) == 30
            assert [(k["level"], k["band"]) for k in r["k"]] == fb.kurtogram_nodes(len(x), 3)
    assert [k["kurtosis"] for k in found[4]["k"]] == [0.0] * 24
    assert frame.limit(0).select(fb.kurtogram(3)("x")).collect() == []
