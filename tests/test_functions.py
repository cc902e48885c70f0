"""Signals, features, joins and state against independent computations, and degenerate windows."""

import math
import struct

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tremora.functions import dsp, power
from tremora.functions.features import features, finished, merged, moments
from tremora.operators import alerts, temporal
from tremora.sources import io

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def waves(spark, *rows):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "id int, x array<double>")


@FEW
@given(st.integers(1, 31), st.floats(0.1, 10), st.floats(0, 6))
def test_pure_tone_shows_in_its_bin_alone(spark, k, level, phase):
    n = np.arange(64)
    frame = waves(spark, level * np.cos(2 * np.pi * k * n / 64 + phase))
    row = frame.select(
        dsp.amplitude(F.col("x"), F.lit(float(k))).alias("a"),
        dsp.rfft("x").alias("s"),
        dsp.amplitude(F.col("x"), F.lit(40.0)).alias("over")
    ).first()
    assert math.isclose(row["a"], level, rel_tol=1e-6) and math.isclose(row["s"][k], level, rel_tol=1e-6)
    assert max(a for i, a in enumerate(row["s"]) if i != k) < 1e-9 * max(1, level) and row["over"] is None


@FEW
@given(st.lists(st.floats(-100, 100), min_size=8, max_size=32))
def test_parseval(spark, x):
    row = waves(spark, x).select(
        dsp.total(
            F.transform(F.sequence(F.lit(0), F.size("x") - 1), lambda k: dsp.bin_power(F.col("x"), k.cast("double")))
        ).alias("p"),
        dsp.array_rms(F.col("x")).alias("r")
    ).first()
    assert math.isclose(row["p"] / len(x) ** 2, row["r"] ** 2, rel_tol=1e-6, abs_tol=1e-9)


@FEW
@given(st.floats(60, 60000), st.integers(5, 30), st.floats(1, 20), st.floats(30, 200), st.floats(0, 40))
def test_race_frequencies_add_up(spark, rpm, n, ball, pitch, contact):
    f = dsp.bearing_frequencies(*(F.lit(float(v)) for v in (rpm, n, ball, pitch, contact)))
    row = spark.range(1).select(*(c.alias(k) for k, c in f.items())).first()
    assert math.isclose(
        row["bpfo"] + row["bpfi"], n * rpm / 60, rel_tol=1e-9
    ) and math.isclose(row["bpfo"], n * row["ftf"], rel_tol=1e-9)


def test_golden_sidebands(spark):
    low, high = dsp.sidebands(F.lit(60.0), F.lit(0.03))
    assert [round(v, 6) for v in spark.range(1).select(low, high).first()] == [56.4, 63.6]


def test_degenerate_windows(spark):
    frame = spark.createDataFrame(
        [("one", 3.0), ("flat", 2.0), ("flat", 2.0), ("cut", 0.0), ("cut", 0.0), ("null", None)], "k string, v double"
    )
    direct = {r["k"]: r for r in frame.groupBy("k").agg(*features(F.col("v"))).collect()}
    rolled = {
        r["k"]: r
        for r in frame.groupBy("k", F.rand(1) > 0.5)
            .agg(*moments(F.col("v"), 1.0))
            .groupBy("k")
            .agg(*merged())
            .select("k", *finished(1.0))
            .collect()
    }
    assert direct["one"]["std"] is None and direct["one"]["kurtosis"] is None and direct["flat"]["std"] == 0
    assert direct["cut"]["crest"] is None and direct["null"]["n"] == 0 and direct["null"]["rms"] is None
    for k in ("one", "flat", "cut"):
        assert rolled[k][
            "crest"
        ] == direct[k]["crest"] and rolled[k]["rms"] == direct[k]["rms"] and rolled[k]["std"] == direct[k]["std"]


def test_power_of_a_shifted_load(spark):
    t = np.arange(200) / 200
    frame = spark.createDataFrame(
        pd.DataFrame(
            {"v": np.sqrt(2) * 230 * np.cos(2 * np.pi * t), "i": np.sqrt(2) * 10 * np.cos(2 * np.pi * t - np.pi / 3)}
        )
    )
    row = frame.agg(*(c.alias(k) for k, c in power.power_triangle(F.col("v"), F.col("i")).items())).first()
    assert math.isclose(row["active"], 1150, rel_tol=1e-9) and math.isclose(
        row["power_factor"], 0.5, rel_tol=1e-9
    ) and math.isclose(
        row["reactive"], 2300 * math.sin(math.pi / 3), rel_tol=1e-9
    )
    d, q = power.park(F.lit(1.0), F.lit(-0.5), F.lit(-0.5))
    assert [round(x, 9) for x in spark.range(1).select(d, q).first()] == [round(math.sqrt(1.5), 9), 0]


MINUTE = 60_000_000


def brute_throttle(times, quiet):
    out = []
    for t in sorted(times):
        if not out or t - out[-1] >= quiet:
            out.append(t)
    return out


@FEW
@given(st.lists(st.integers(0, 100), max_size=40))
def test_throttle_is_the_sequential_rule(spark, minutes):
    frame = spark.createDataFrame([(1, m * MINUTE) for m in minutes], "d int, us long")
    assert sorted(
        r["us"] for r in alerts.throttle(frame, "d", "us", 15 * MINUTE).collect()
    ) == brute_throttle([m * MINUTE for m in minutes], 15 * MINUTE)


def test_throttle_at_the_boundary(spark):
    frame = spark.createDataFrame([(1, 0), (1, 15 * MINUTE - 1), (2, 0), (2, 15 * MINUTE)], "d int, us long")
    assert {
        (r["d"], r["us"]) for r in alerts.throttle(frame, "d", "us", 15 * MINUTE).collect()
    } == {(1, 0), (2, 0), (2, 15 * MINUTE)}


def test_cusum_and_hysteresis_are_sequential(spark):
    values = [float(v) for v in np.random.default_rng(4).normal(0.2, 1, 200)]
    frame = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "d int, t int, v double")
    got = [
        (r["cusum"], r["alarm"])
        for r in alerts.hysteresis(alerts.cusum(frame, ["d"], ["t"], F.col("v"), 0.1), ["d"], ["t"], "v", 1.0, -1.0)
            .orderBy("t")
            .collect()
    ]
    s, on = 0.0, 0
    for v, (c, a) in zip(values, got, strict=True):
        s, on = max(0.0, s + v - 0.1), 1 if v > 1 else 0 if v < -1 else on
        assert math.isclose(c, s, abs_tol=1e-9) and a == on


def test_asof_matches_pandas(spark):
    rng = np.random.default_rng(5)
    left = pd.DataFrame({"d": rng.integers(0, 3, 60), "t": rng.permutation(600)[:60]}).sort_values("t")
    right = pd.DataFrame(
        {"d": rng.integers(0, 3, 60), "t": rng.permutation(600)[:60], "v": rng.random(60)}
    ).sort_values("t")
    want = pd.merge_asof(left, right, on="t", by="d", tolerance=40)
    got = temporal.asof(
        spark.createDataFrame(left), spark.createDataFrame(right), ["d"], "t", ["v"], F.lit(40)
    ).toPandas()
    key = ["d", "t"]
    assert np.allclose(got.sort_values(key)["v"].astype(float), want.sort_values(key)["v"], equal_nan=True)


def test_interval_join_at_its_edges(spark):
    left = spark.createDataFrame([("a", 100, 1), ("a", 0, 2)], "k string, t long, i int")
    right = spark.createDataFrame(
        [("a", 110, 1), ("a", 111, 2), ("a", 90, 3), ("b", 100, 4), ("a", -10, 5)], "k string, u long, j int"
    )
    assert {
        (r["i"], r["j"]) for r in temporal.interval(left, right, "k", "t", "u", 10).collect()
    } == {(1, 1), (1, 3), (2, 5)}


def cbor(value):
    if isinstance(value, dict):
        return bytes([0xA0 | len(value)]) + b"".join(cbor(k) + cbor(v) for k, v in value.items())
    if isinstance(value, str):
        return bytes([0x60 | len(value)]) + value.encode()
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    if value < 0:
        return bytes([0x20 | (-1 - value)])
    return bytes([value]) if value < 24 else b"\x19" + value.to_bytes(2, "big")


def test_payloads(spark):
    good = cbor({"rms": 1.5, "rpm": 1800, "t": -4})
    frame = spark.createDataFrame([(good,), (good[:-3],), (None,), (b"\x01",)], "p binary")
    assert [
        r["m"] for r in frame.select(io.cbor_numbers("p").alias("m")).collect()
    ] == [{"rms": 1.5, "rpm": 1800.0, "t": -4.0}, None, None, None]
    raw = spark.createDataFrame([('{"device_id": "d", "value": 2.5}',), ("{broken",), (None,)], "payload string")
    rows, bad = io.parse_telemetry(raw)
    assert [r["value"] for r in rows.collect()] == [2.5] and bad.count() == 2


def test_waveform_files_and_sinks(spark, tmp_path):
    folder = tmp_path / "waveforms" / "dev1" / "20240101T000000"
    folder.mkdir(parents=True)
    (folder / "x_axis.bin").write_bytes(struct.pack("<3f", 1, 2, 3) + b"\0")
    row = io.waveforms(spark, str(tmp_path / "waveforms")).first()
    assert (row["device_id"], row["axis"], row["samples"]) == ("dev1", "x", [1.0, 2.0, 3.0])
    rows = spark.createDataFrame(
        [("vib", "P1", 1.0), ("temp", "P3", 2.0)], "channel string, severity string, value double"
    ).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    io.write_metrics(rows, str(tmp_path / "metrics"))
    assert spark.read.parquet(str(tmp_path / "metrics")).where("channel = 'vib'").count() == 1
    io.route_alerts(rows, str(tmp_path / "alerts"))
    assert {r["channel"] for r in spark.read.parquet(str(tmp_path / "alerts")).collect()} == {"pager", "dashboard"}


def test_order_spectrum_of_a_run_up_is_sharp(spark):
    turns = np.linspace(0, 1, 400) ** 2 * 8
    x = np.cos(2 * np.pi * 3 * turns)
    frame = spark.createDataFrame([(x.tolist(), turns.tolist())], "x array<double>, a array<double>")
    spectrum = np.array(frame.select(dsp.rfft(dsp.order_resample(256)("x", "a")).alias("s")).first()["s"])
    assert int(np.argmax(spectrum)) == 24 and spectrum[24] > 0.9


@pytest.mark.parametrize("name", ["kurtosis", "skewness"])
def test_moments_of_a_normal_sample(spark, name):
    values = np.random.default_rng(8).normal(size=2000)
    x = waves(spark, values)
    m2, mk = (
        dsp.central_moment(F.col("x"), dsp.array_mean(F.col("x")), k) for k in (2, 4 if name == "kurtosis" else 3)
    )
    got = x.select(m2.alias("a"), mk.alias("b")).first()
    assert abs(got["b"] / got["a"] ** (2 if name == "kurtosis" else 1.5) - (3 if name == "kurtosis" else 0)) < 0.3


def test_suppression_folds_a_long_run_without_gathering_it(spark):
    from pyspark.sql import functions as F

    from tremora.operators.alerts import throttle

    alerts = spark.range(30_000).select(
        (F.col("id") % 3).alias("d"), (F.col("id") * F.col("id") % 9973 + F.col("id")).alias("us")
    )
    alerts = alerts.withColumn("d", F.when(F.col("d") > 0, F.col("d")))
    got = throttle(alerts, "d", "us", 7)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    want, last = [], {}
    for d, us in sorted((r["d"] or 0, r["us"]) for r in alerts.collect()):
        if d not in last or us - last[d] >= 7:
            want.append((d, us))
            last[d] = us
    assert sorted((r["d"] or 0, r["us"]) for r in got.collect()) == want


def _embeddings(sf):
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{sf}/embeddings.parquet").to_pylist()
    return {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in rows}


def test_order_resampling_equals_interpolation(spark, sf):
    from tremora.plans.signal import order_resample

    waves = _embeddings(sf)
    for r in order_resample(spark, sf).collect():
        x = waves[r["vec_id"]]
        n = len(x)
        u = np.arange(n) / n
        turns = 4 * u + 2 * u * u
        even = np.interp(np.linspace(turns[0], turns[-1], 128), turns, x)
        s = 2 * np.abs(np.fft.rfft(even)) / 128
        assert np.isclose(r["order_1"], s[6], atol=1e-6) and np.isclose(r["order_2"], s[12], atol=1e-6)


def test_residuals_equal_a_plain_decomposition(spark, sf, tmp_path):
    from tremora.plans.models import pca_residual

    waves = _embeddings(sf)
    x = np.array([waves[k] for k in sorted(waves)])
    centred = x - x.mean(axis=0)
    basis = np.linalg.svd(centred, full_matrices=False)[2][:8].T
    want = dict(zip(sorted(waves), np.linalg.norm(centred - centred @ basis @ basis.T, axis=1), strict=True))
    for r in pca_residual(spark, sf).collect():
        assert np.isclose(r["residual"], want[r["vec_id"]], atol=1e-5)
    spark.createDataFrame(
        [(1, None, 1)], "vec_id long, embedding array<float>, label int"
    ).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert pca_residual(spark, str(tmp_path)).collect() == []


def test_classifier_tells_faults_of_windows_it_has_not_seen(spark, sf, tmp_path):
    """The labels of the given table follow no signal; here each fault has a line of its own."""
    from tremora.plans.records import fault_classifier

    rng = np.random.default_rng(1)
    t = np.arange(64)
    rows = [
        (i, (np.sin(2 * np.pi * (2 + i % 4) * t / 64 + rng.uniform(0, 6)) + rng.normal(0, 0.4, 64)).tolist(), i % 4)
        for i in range(300)
    ]
    spark.createDataFrame(
        rows, "vec_id long, embedding array<float>, label int"
    ).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = fault_classifier(spark, str(tmp_path)).collect()
    held = [r["fault_class"] == r["vec_id"] % 4 for r in got if r["held_out"]]
    assert len(got) == 300 and len(held) == 60 and np.mean(held) > 0.9
    assert all(0 <= r["confidence"] <= 1 for r in got)


def test_filters_refuse_bands_above_half_the_rate():
    import pytest

    with pytest.raises(ValueError):
        dsp.band_taps(10_000.0, 40_000.0, 64_000.0)
    x = np.random.default_rng(0).normal(size=(3, 50))
    taps = dsp.band_taps(1000.0, 5000.0, 64_000.0)
    for row, got in zip(x, dsp.filtered(x, taps), strict=True):
        assert np.allclose(got, np.convolve(row, taps, "full")[15:65])


def test_decimation_keeps_slow_and_drops_fast_lines(spark):
    t = np.arange(1024)
    rows = spark.createDataFrame(
        [(0, np.sin(2 * np.pi * t / 64).tolist()), (1, np.sin(2 * np.pi * t * 0.45).tolist())], "i int, x array<double>"
    )
    for r in rows.select("i", dsp.decimated(4)("x").alias("y")).collect():
        y = np.array(r["y"])[32:-32]
        assert len(r["y"]) == 256 and (abs(y).max() > 0.95 if r["i"] == 0 else abs(y).max() < 0.05)


def test_quantiles_of_odd_groups_hold_no_group_in_a_task(spark):
    """One value of 1e12, groups of one value, of one row, of null keys and values, with NaN; sketches that err."""
    from tremora.operators import ranks

    rng = np.random.default_rng(4)
    rows = [("a", float(v)) for v in rng.lognormal(2, 3, 30_000)] + [("a", 1e12), ("a", None)]
    rows += [("b", 7.0)] * 5000 + [("c", 1.5), ("d", None), (None, 1.0), (None, 3.0)]
    rows += [("e", v) for v in (1.0, 2.0, float("nan"), float("nan"))]
    frame = spark.createDataFrame(rows, "g string, v double")
    wanted = {"x0": 0.0, "x1": 0.001, "x50": 0.5, "x99": 0.99, "x100": 1.0}
    want = {}
    for g in {g for g, _ in rows}:
        own = sorted((v for h, v in rows if h == g and v is not None), key=lambda v: (np.isnan(v), v))
        if own:
            at = {n: q * (len(own) - 1) for n, q in wanted.items()}
            want[g] = {
                n: own[int(a)] if a == int(a) else own[int(a)] + (own[int(a) + 1] - own[int(a)]) * (a - int(a))
                for n, a in at.items()
            }
    margin = ranks.MARGIN
    for ranks.MARGIN in (margin, -0.01):  # bounds that miss the rank make no result wrong
        for window in (None, F.col("v") % 5):
            got = {r["g"]: r for r in ranks.quantiles(frame, ["g"], "v", wanted, window).collect()}
            assert set(got) == set(want)
            for g, of in want.items():
                assert all(got[g][n] == pytest.approx(v, rel=1e-12, nan_ok=True) for n, v in of.items()), g
    ranks.MARGIN = margin
    cells = ranks._cells(frame.where("g = 'a' and v is not null").distinct(), ["g"], "v").groupBy("__cell").count()
    sizes = [r["count"] for r in cells.collect()]
    assert len(sizes) == ranks.CELLS and max(sizes) < 30_000 / ranks.CELLS * 1.5


def test_quantiles_ranks_and_trailing_sums(spark):
    from tremora.operators.ranks import numbered, quantile
    from tremora.operators.temporal import trailing

    rng = np.random.default_rng(3)
    rows = [
        (g, i, float(v))
        for g in "ab"
        for i, v in enumerate(np.concatenate((rng.normal(size=400), np.full(50, 1.5), [1e9])))
    ] + [("c", 0, 7.0), ("d", 0, None)]
    frame = spark.createDataFrame(rows, "g string, i long, v double")
    for q in (0.0, 0.3, 0.5, 0.99, 1.0):
        got = {r["g"]: r["x"] for r in quantile(frame, ["g"], "v", q, "x").collect()}
        assert got == {g: np.quantile([v for h, _, v in rows if h == g], q) for g in "abc"}
    places = {
        (r["g"], r["i"]): r["p"]
        for r in numbered(frame.where("g = 'a'"), ["g"], [F.floor(F.col("i") / 37)], ["i"], "p").collect()
    }
    assert places == {("a", i): i + 1 for i in range(451)}
    got = {
        (r["g"], r["i"]): r["n_w"]
        for r in trailing(frame.where("g <> 'd'"), ["g"], "i", "i", "v", {"w": 9}, current=True).collect()
    }
    assert got == {(g, i): min(i, 9) + 1 for g, i, _ in rows if g != "d"}


@pytest.mark.parametrize("current", [False, True])
def test_trailing_moments_keep_the_digits_of_any_size(spark, current):
    """Values of 1e-9, of 1e15 and around a large level in one history, with nulls, NaN, ties and gaps."""
    from tremora.operators.temporal import trailing

    rng = np.random.default_rng(9)
    rows, at = [], 0
    for level, spread in ((1e-8, 1e-9), (1e15, 1e12), (0.0, 1.0), (1e7, 1e-3), (-3e-5, 1e-6)):
        at += 1000
        for _ in range(60):
            at += int(rng.integers(0, 9))
            rows.append((at, float(level + spread * rng.normal())))
    rows += [(at + 500, None), (at + 501, 2.0), (at + 900, float("nan")), (at + 905, 1.0), (at + 2000, 3.0)]
    frame = spark.createDataFrame([("g", i, t, v) for i, (t, v) in enumerate(rows)], "g string, i int, t long, v double")
    got = {r["i"]: r for r in trailing(frame, ["g"], "i", "t", "v", {"a": 40, "b": 7}, current).collect()}
    for i, (t, _) in enumerate(rows):
        for name, width in (("a", 40), ("b", 7)):
            own = np.array([v for u, v in rows if v is not None and t - width <= u and (u <= t if current else u < t)])
            r = got[i]
            assert r[f"n_{name}"] == len(own)
            if len(own):
                assert r[f"mean_{name}"] == pytest.approx(own.mean(), rel=1e-12, nan_ok=True)
                assert r[f"m2_{name}"] == pytest.approx(((own - own[0]) - (own - own[0]).mean()).dot((own - own[0]) - (own - own[0]).mean()), rel=1e-6, abs=1e-25, nan_ok=True)
            else:
                assert r[f"mean_{name}"] is None


def test_csv_rows_that_do_not_fit_go_to_quarantine(spark, tmp_path):
    from tremora.sources import io

    (tmp_path / "x.csv").write_text("a,b\n1,2.5\nx,3\n4,5\n")
    good, bad = io.csv_rows(spark, str(tmp_path), "a long, b double")
    assert sorted(map(tuple, good.collect())) == [(1, 2.5), (4, 5.0)] and [
        r["_broken"] for r in bad.collect()
    ] == ["x,3"]


def test_cusum_by_blocks_equals_the_whole(spark):
    values = [float(v) for v in np.random.default_rng(5).normal(0.1, 1, 300)]
    frame = spark.createDataFrame([(d, i, v) for d in (1, 2) for i, v in enumerate(values)], "d int, t int, v double")
    for block in (None, F.floor(F.col("t") / 17)):
        level, want = 0.0, []
        for v in values:
            level = max(0.0, level + v - 0.1)
            want.append(level)
        got = [
            r["cusum"]
            for r in alerts.cusum(frame, ["d"], ["t"], F.col("v"), 0.1, block).where("d = 2").orderBy("t").collect()
        ]
        assert np.allclose(got, want)
