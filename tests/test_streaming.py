"""Streams against their batch forms, over several micro-batches."""

import datetime

import pytest
from pyspark.sql import functions as F

from tremora.functions.features import features
from tremora.streaming import jobs

START = datetime.datetime(2024, 1, 1)


def files(spark, tmp_path, batches, schema):
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"b={i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true"
    ).parquet(str(folder))


EVENT = "event_id long, user_id long, event_type string, ts timestamp, value double"


def event(i, minute, user=1, kind="view", value=None):
    return (i, user, kind, START + datetime.timedelta(minutes=minute), float(i if value is None else value))


def test_append_windows_equal_batch_once_the_watermark_passes(spark, tmp_path):
    batches = [
        [event(i, i * 3) for i in range(20)],
        [event(100 + i, i * 2 + 1) for i in range(20)],
        [event(999, 3 * 24 * 60)],
        [event(1000, 6 * 24 * 60)]
    ]
    stream = files(spark, tmp_path, batches, EVENT)
    got = jobs.drained(jobs.window_features(stream, "10 minutes"))
    closed = spark.createDataFrame(batches[0] + batches[1], EVENT).groupBy(
        F.col("event_type").alias("channel"), F.window("ts", "10 minutes").alias("w")
    ).agg(*features(F.col("value")))
    rows = {str(r) for r in got.where("w.start < timestamp'2024-01-02'").collect()}
    assert rows == {str(r) for r in closed.collect()}


def test_throttle_state_spans_batches(spark, tmp_path):
    stream = files(
        spark,
        tmp_path,
        [
            [event(1, 0), event(2, 10), event(3, 10, user=2)],
            [event(4, 14.9), event(5, 24.9, user=2)],
            [event(6, 15), event(7, 29), event(8, 30)]
        ],
        EVENT
    )
    got = {
        (r["device_id"], r["us"] // 60_000_000) for r in jobs.drained(jobs.throttled(stream, 15 * 60_000_000)).collect()
    }
    base = int(START.replace(tzinfo=datetime.UTC).timestamp()) // 60
    assert got == {(1, base), (2, base + 10), (1, base + 15), (1, base + 30)}


def test_lifecycle_counts_steps_back(spark, tmp_path):
    schema = "alert_id long, ts timestamp, status string"
    at = lambda m: START + datetime.timedelta(minutes=m)
    stream = files(
        spark,
        tmp_path,
        [
            [(1, at(0), "OPEN"), (2, at(0), "OPEN")],
            [(1, at(1), "RESOLVED")],
            [(1, at(2), "ACKNOWLEDGED"), (2, at(3), "ACKNOWLEDGED")]
        ],
        schema
    )
    rows = jobs.drained(jobs.lifecycle(stream), "update").collect()
    assert max((r["illegal"], r["status"]) for r in rows if r["alert_id"] == 1) == (1, "RESOLVED")
    assert {r["status"] for r in rows if r["alert_id"] == 2} == {"OPEN", "ACKNOWLEDGED"}


def test_duplicates_across_batches_count_once(spark, tmp_path):
    stream = files(spark, tmp_path, [[event(1, 0), event(2, 1)], [event(1, 0), event(3, 2)]], EVENT)
    assert sorted(
        r["event_id"] for r in jobs.drained(jobs.deduplicated(stream, ["user_id", "event_id"])).collect()
    ) == [1, 2, 3]


@pytest.mark.parametrize("limit", [60])
def test_silence_is_reported_by_a_timer(spark, tmp_path, limit):
    stream = files(
        spark,
        tmp_path,
        [[event(1, 0), event(2, 0, user=2)], [event(3, 50)], [event(4, 100, user=3)], [event(5, 200, user=3)]],
        EVENT
    )
    got = jobs.drained(jobs.silent(stream, limit * 60_000)).collect()
    assert {r["device_id"] for r in got} >= {1, 2}


def test_events_are_read_from_a_file_and_from_a_folder_of_parts(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    assert jobs.drained(jobs.event_stream(spark, sf)).count() == events.count() > 0
    assert jobs.drained(jobs.event_stream(spark, str(tmp_path))).count() == events.count()


def test_a_restarted_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """State and offsets outlive the run: the second run sees the second file alone, and still knows the last alert."""
    at = lambda minutes: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)
    source = tmp_path / "events.parquet"
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    write = lambda minutes: spark.createDataFrame([(m, at(m), 7, "error", 1.0, None) for m in minutes], schema).coalesce(1).write.mode("append").parquet(str(source))
    write([0, 5, 20])
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    run = lambda: jobs.continued(jobs.throttled(jobs.event_stream(spark, str(tmp_path)), 15 * 60 * 1_000_000), out, state)
    emitted = lambda: sorted(r["us"] // 60_000_000 - 28401120 for r in spark.read.option("recursiveFileLookup", "true").parquet(out).collect())
    run()
    assert emitted() == [0, 20]
    write([30, 36])
    run()
    run()
    assert emitted() == [0, 20, 36]
