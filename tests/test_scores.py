"""Scores by machine, lagged correlation, private means and escalation under rules."""

import datetime
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremora.operators import anomaly, lags
from tremora.operators.alerts import escalation
from tremora.operators.privacy import private_mean
from tremora.streaming import jobs

START = datetime.datetime(2024, 1, 1)


def test_distances_and_percentiles_equal_a_plain_solve(spark):
    rng = np.random.default_rng(1)
    rows, i = [], 0
    for machine, n in (("a", 200), ("b", 60), (None, 5), ("short", 4), ("flat", 50), ("line", 50)):
        mix = rng.normal(size=(3, 3))
        for _ in range(n):
            x = (rng.normal(size=3) @ mix + 50).tolist()
            if machine == "flat":
                x[1] = 2.0
            if machine == "line":
                x[2] = 2 * x[0] - x[1]
            rows.append((i, machine, x))
            i += 1
    rows += [(9000, "a", [1000.0, 0.0, 50.0]), (9001, "a", None), (9002, "b", [1.0, None, 2.0]), (9003, "b", [float("nan"), 1.0, 2.0])]
    rows += [(9004, "b", rows[210][2]), (9005, "new", [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame(rows, "i long, m string, x array<double>").repartition(5)
    want = {}
    for machine in ("a", "b"):
        own = {k: np.array(x) for k, m, x in rows if m == machine and x and None not in x and np.isfinite(x).all()}
        values = np.array(list(own.values()))
        inverse = np.linalg.inv(np.cov(values.T, bias=True))
        score = {k: np.sqrt((x - values.mean(axis=0)) @ inverse @ (x - values.mean(axis=0))) for k, x in own.items()}
        for k, s in score.items():
            want[k] = s, np.mean([round(o, 6) <= round(s, 6) for o in score.values()])
    for held in (anomaly.HELD, 1):
        anomaly.HELD, before = held, anomaly.HELD
        got = {r["key"]: r for r in anomaly.scored(frame, "m", "i", "x").collect()}
        anomaly.HELD = before
        assert set(got) == {k for k, _, _ in rows}
        for k, r in got.items():
            if k in want:
                assert r["score"] == pytest.approx(want[k][0], abs=2e-6)
                assert r["percentile"] == pytest.approx(want[k][1], abs=0.011)
            else:
                assert r["score"] is None and r["percentile"] is None
    assert got[9000]["percentile"] == 1.0
    assert anomaly.scored(frame.limit(0), "m", "i", "x").collect() == []


def test_a_planted_lag_is_found(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=600)
    rows = []
    for i, lag in enumerate((-17, 0, 5, 24)):
        own = {t: float(base[t]) for t in range(100, 500) if rng.random() < 0.7}
        other = {t: float(-base[t - lag] + 0.3 * rng.normal()) for t in range(130, 470) if rng.random() < 0.7}
        rows.append((i, list(own.items()), list(other.items())))
    rows += [(10, [], [(1, 1.0)]), (11, None, [(1, 1.0)]), (12, [(1, 2.0), (5, 2.0)], [(1, 1.0), (2, 3.0)])]
    frame = spark.createDataFrame(rows, "i int, a array<struct<h:long,v:double>>, b array<struct<h:long,v:double>>")
    got = {r["i"]: r["x"] for r in frame.select("i", lags.best_lag(30)("a", "b").alias("x")).collect()}
    assert [got[i]["lag"] for i in range(4)] == [-17, 0, 5, 24] and all(got[i]["r"] < -0.5 for i in range(4))
    assert got[10] is None and got[11] is None and got[12] is None
    a, b = rng.normal(size=50), rng.normal(size=50)
    plain = [
        sum(a[t] * b[t + k] for t in range(50) if 0 <= t + k < 50) / np.sqrt((a @ a) * (b @ b)) for k in range(-9, 10)
    ]
    assert np.allclose(lags.correlations(a, b, 9), plain)


def test_noise_is_drawn_anew_and_has_its_scale(spark):
    one = spark.range(1).selectExpr("100.0D m", "3L n")
    draws = [private_mean(one, "m", "n", 50.0, 150.0, 2.0).first()[0] for _ in range(3)]
    assert len(set(draws)) == 3
    many = spark.range(20_000).selectExpr("100.0D m", "1L n")
    from tremora.operators.privacy import laplace

    noise = np.array([r[0] for r in many.select(laplace(2.0)).collect()])
    assert abs(noise.mean()) < 0.15 and abs(np.abs(noise).mean() - 2.0) < 0.1 and abs(noise.var() - 8.0) < 1.0
    far = spark.range(10_000).selectExpr("1e9D m", "1L n")
    assert abs(private_mean(far, "m", "n", 50.0, 150.0, 2.0).first()[0] - 150) < 0.3


def _levels(spark, rows, rules):
    frame = spark.createDataFrame(rows, "d int, kind string, us long, i long")
    alerts = frame.where("kind = 'alert'").select("d", "us", F.col("i").alias("a"), F.lit(0).cast("long").alias("site"))
    seen = frame.groupBy("d").agg(F.max("us").alias("seen"))
    steps = spark.createDataFrame([(0, k, us) for k, us in rules], "site long, level int, after_us long")
    found = escalation(alerts, frame.where("kind = 'ack'").select("d", "us"), seen, steps, "d", "a", "us", 1000)
    return sorted(tuple(r) for r in found.collect())


def test_levels_equal_a_plain_walk_and_follow_the_rules(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 3)), str(rng.choice(["alert", "ack", "x"])), int(rng.integers(0, 20_000)), i) for i in range(300)]
    found = []
    for rules in ([(1, 100), (2, 1500)], [(1, 300), (2, 1500), (3, 4000)]):
        want = []
        for d, kind, us, i in rows:
            if kind == "alert":
                seen = max(u for e, _, u, _ in rows if e == d)
                acked = min((u for e, k, u, _ in rows if e == d and k == "ack" and u > us), default=None)
                want += [(i, k) for k, s in rules if us + s <= seen and (acked is None or acked > us + s)]
        found.append(_levels(spark, rows, rules))
        assert found[-1] == sorted(want)
    assert found[0] != found[1]


def test_one_device_of_any_length_costs_a_sort(spark):
    rows = spark.range(80_000).select(F.lit(1).alias("d"), (F.col("id") * 10).alias("us"), F.col("id").alias("a"))
    alerts = rows.withColumn("site", F.lit(0).cast("long"))
    seen = rows.groupBy("d").agg(F.max("us").alias("seen"))
    rules = spark.createDataFrame([(0, 1, 500)], "site long, level int, after_us long")
    began = time.time()
    found = escalation(alerts, rows.where("a % 20 = 0").select("d", "us"), seen, rules, "d", "a", "us", 100_000).count()
    assert time.time() - began < 30 and found == 0


def test_rules_are_the_state_that_a_stream_begins_with(spark, tmp_path):
    at = lambda minutes: START + datetime.timedelta(minutes=minutes)
    schema = "event_id long, user_id long, event_type string, ts timestamp, value double"
    rows = [(1, 1, "alert", at(0), 0.0), (2, 2, "alert", at(0), 0.0), (3, 3, "alert", at(0), 0.0)]
    rows += [(9, d, "x", at(60 * 24 * 5), 0.0) for d in (1, 2, 3)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    minute = 60_000_000
    for first in (10, 60 * 24 * 30):  # a rule that is due, and one that isn't
        rules = spark.createDataFrame(
            [(1, 1, first * minute), (2, 1, 30 * minute), (2, 2, 40 * minute)], "device_id long, level int, after_us long"
        )
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("kind", F.col("event_type"))
        got = jobs.drained(jobs.escalated(stream, [20 * minute], rules=rules)).collect()
        due = [(1, 1)] if first == 10 else []
        assert sorted(tuple(r) for r in got) == [*due, (2, 1), (2, 2), (3, 1)]
