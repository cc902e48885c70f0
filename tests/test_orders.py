"""Order tracking, and joins in time whose groups are dealt into blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremora.functions import dsp
from tremora.operators import orders, temporal


def test_blocks_give_the_join_of_whole_groups(spark):
    rng = np.random.default_rng(6)
    left = pd.DataFrame({"d": rng.integers(0, 3, 400), "t": rng.integers(0, 5000, 400), "i": range(400)})
    right = pd.DataFrame({"d": rng.integers(0, 3, 40), "t": rng.integers(0, 5000, 40), "v": range(40)})
    right = right.drop_duplicates(["d", "t"])
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("t"), on="t", by="d")
    want = {r.i: None if np.isnan(r.v) else int(r.v) for r in want.itertuples()}
    for width in (None, 7, 100, 3000, 10**6):
        found = temporal.asof(
            spark.createDataFrame(left), spark.createDataFrame(right), ["d"], "t", ["v"], width=width
        )
        assert {r["i"]: r["v"] for r in found.collect()} == want, width
    empty = temporal.asof(spark.createDataFrame(left), spark.createDataFrame(right).limit(0), ["d"], "t", ["v"], width=9)
    assert empty.count() == 400 and empty.where("v is not null").isEmpty()


@pytest.mark.parametrize("ahead", [False, True])
def test_neighbours_across_blocks(spark, ahead):
    rng = np.random.default_rng(7)
    rows = [(int(d), int(t), i) for i, (d, t) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(0, 900, 200)))]
    frame = spark.createDataFrame(rows, "d int, t int, i int")
    near = {}
    for d in range(3):
        own = sorted((t, i) for e, t, i in rows if e == d)
        for a, b in zip(own, own[1:]):
            near[(b if not ahead else a)[1]] = (a if not ahead else b)[1]
    for width in (1, 50, 10_000):
        found = temporal.beside(frame, ["d"], F.floor(F.col("t") / width), ["t", "i"], ["i"], "n", ahead)
        assert {r["i"]: r["n"] and r["n"]["i"] for r in found.collect()} == {i: near.get(i) for _, _, i in rows}


def test_the_line_of_an_order_stays_in_one_bin_over_a_ramp(spark):
    """A shaft that runs up from 5 to 25 turns a second; its third order smears in time and is one line by angle."""
    rate, seconds = 2000, 8
    t = np.arange(rate * seconds) / rate
    turns = 5 * t + 20 / (2 * seconds) * t * t
    x = np.cos(2 * np.pi * 3 * turns) + 0.3 * np.cos(2 * np.pi * 7.5 * turns)
    samples = spark.createDataFrame(pd.DataFrame({"d": 1, "us": (t * 1e6).astype(int), "i": range(len(t)), "v": x}))
    edges = np.interp(np.arange(0, turns[-1]), turns, t)
    pulses = spark.createDataFrame(pd.DataFrame({"d": 1, "us": np.round(edges * 1e6).astype(int)}))
    pulses = pulses.union(pulses.limit(5))  # pulses that come twice
    phased = orders.shaft_phase(samples, pulses, ["d"], "us", 500_000)
    for r in phased.where("i % 997 = 0").collect():
        assert abs(r["position"] - turns[r["i"]]) < 0.02
    even = orders.even_steps(phased, ["d"], ["us", "i"], "v", points=64, turns=16)
    spectra = orders.order_spectra(even, ["d"], "v", points=64, turns=16).orderBy("block").collect()
    # the first stretch lacks step 0, which no sample lies before
    assert [r["block"] for r in spectra] == list(range(1, int(turns[-1] - 1) // 16))
    for r in spectra:
        s = np.array(r["spectrum"])
        assert s.argmax() == 48 and s[48] > 0.9 and 0.25 < s[120] < 0.31 and s[[46, 50]].max() < 0.1
    whole = np.array(
        spark.createDataFrame([(x.tolist(),)], "x array<double>").select(dsp.rfft("x").alias("s")).first()["s"]
    )
    assert whole.max() < 0.3  # the same line in time


def test_odd_rows_of_resampling(spark):
    rows = [(None, [0.0, 1.0]), ([], []), ([1.0, 2.0], [0.0]), ([1.0, 2.0], [3.0, 3.0]), ([1.0, 3.0, 5.0], [0.0, 1.0, 2.0])]
    frame = spark.createDataFrame(rows, "x array<double>, a array<double>")
    got = [r["y"] for r in frame.select(dsp.order_resample(5)("x", "a").alias("y")).collect()]
    assert got == [None, None, None, None, [1.0, 2.0, 3.0, 4.0, 5.0]]


def test_no_pulses_no_phase(spark):
    samples = spark.createDataFrame([(1, 5, 0, 1.0)], "d int, us long, i long, v double")
    pulses = spark.createDataFrame([(1, 3)], "d int, us long")
    assert orders.shaft_phase(samples, pulses, ["d"], "us", 10).collect() == []
    assert orders.shaft_phase(samples, pulses.limit(0), ["d"], "us", 10).collect() == []
