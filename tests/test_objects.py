"""Waveform objects read by range: what is read, and how little."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremora.plans.records import column_encryption
from tremora.session import shared_dir
from tremora.sources import objects


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    rows = [(m, k, rng.normal(size=1000 + 7 * k % 50).astype(float).tolist()) for m in range(4) for k in range(100)]
    rows += [(1, 500, []), (None, 1, [1.0]), (2, None, [1.0]), (3, 700, None)]
    waves = spark.createDataFrame(rows, "machine int, key long, samples array<float>")
    path = str(tmp_path_factory.mktemp("objects")) + "/store"
    objects.write_objects(waves, path)
    return path, {(m, k): x for m, k, x in rows if None not in (m, k, x)}


def test_ranges_equal_slices(spark, folder):
    path, waves = folder
    for first, last in ((0, None), (10, 20), (990, 5000), (5000, 6000), (3, 3)):
        got = {(r["machine"], r["key"]): r["samples"] for r in objects.waveform_ranges(spark, path, first, last).collect()}
        assert set(got) == set(waves)
        for k, x in waves.items():
            assert np.allclose(got[k], np.array(x[first:last], dtype=np.float32))


def test_filters_decide_which_bytes_are_read(spark, folder):
    path, waves = folder
    everything = objects.waveform_ranges(spark, path).agg(F.sum("bytes_read"), F.count("*")).first()
    assert everything[0] >= sum(4 * len(x) for x in waves.values()) and everything[1] == len(waves)
    few = objects.waveform_ranges(spark, path, 16, 32).where("machine = 3 and key >= 20 and key < 30")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan  # both are pushed down
    rows = few.collect()
    assert sorted(r["key"] for r in rows) == list(range(20, 30)) and all(len(r["samples"]) == 16 for r in rows)
    assert sum(r["bytes_read"] for r in rows) < 60_000 < everything[0] / 20
    one = objects.waveform_ranges(spark, path, 0, 4).where("machine in (0, 2) and key in (5, 77, 1000)")
    assert sorted((r["machine"], r["key"]) for r in one.collect()) == [(0, 5), (0, 77), (2, 5), (2, 77)]
    # what can't be pushed down is still applied
    odd = objects.waveform_ranges(spark, path, 0, 4).where("key % 2 = 1 and size(samples) = 4 and machine > 2")
    assert odd.count() == 50


def test_an_empty_store(spark, tmp_path):
    path = str(tmp_path / "none")
    objects.write_objects(spark.createDataFrame([], "machine int, key long, samples array<float>"), path)
    assert objects.waveform_ranges(spark, path).collect() == []


def test_a_cluster_without_a_key_file_seals_with_a_key_of_its_own(spark, sf, monkeypatch):
    shared_dir(spark)  # a cluster comes with one
    monkeypatch.setattr(spark.sparkContext, "master", "spark://cluster:7077")
    rows = column_encryption(spark, sf).collect()
    assert rows and all(r["opened"] and r["sealed_bytes"] == len(r["s_name"]) + 28 for r in rows)
