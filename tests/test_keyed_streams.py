"""Captures, configuration in force, the segment log and the ledger sink: over batches, restarts and lost attempts."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremora.streaming import jobs, keyed, segments
from tremora.streaming.sink import LedgerSink

START = datetime.datetime(2024, 1, 1)
SCHEMA = "event_id long, user_id long, event_type string, ts timestamp, value double"
MINUTE = 60_000_000
BASE = 1_704_067_200_000_000


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def reader(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def made(n, seed, hours=10):
    """Rows of three devices, a little out of order."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        minute = i * hours * 60 / n + rng.uniform(-20, 20)
        kind = rng.choice(["view", "view", "view", "signup"])
        rows.append((i, i % 3, kind, START + datetime.timedelta(minutes=minute), rng.uniform(0, 100)))
    return rows


def read(spark, out):
    return spark.read.option("recursiveFileLookup", "true").parquet(str(out))


def test_captures_span_batches_and_a_restart(spark, tmp_path):
    rows = made(120, 1)
    width = 30 * MINUTE

    def run():
        stream = keyed.captured(reader(spark, tmp_path / "in"), F.col("value") > 85, width, 60 * MINUTE)
        jobs.continued(stream, str(tmp_path / "out"), str(tmp_path / "state"), idle=False)

    for at in range(0, 60, 20):
        write(spark, tmp_path / "in", rows[at : at + 20])
    run()
    for at in range(60, 120, 20):
        write(spark, tmp_path / "in", rows[at : at + 20])
    run()
    run()
    us = lambda t: int(t.replace(tzinfo=datetime.UTC).timestamp() * 1e6)
    want = sorted(
        (t[0], r[0]) for t in rows if t[4] > 85 for r in rows if r[1] == t[1] and abs(us(r[3]) - us(t[3])) <= width
    )
    got = sorted((r["trigger_id"], r["event_id"]) for r in read(spark, tmp_path / "out").collect())
    assert got == want and any(rows[a][3] > rows[b][3] for a, b in want) and any(rows[a][3] < rows[b][3] for a, b in want)


def test_each_event_gets_the_version_of_its_time(spark, tmp_path):
    rows = made(90, 2)
    late = (900, 0, "signup", rows[0][3] + datetime.timedelta(minutes=41), 0.0)
    end = [(990 + d, d, "view", START + datetime.timedelta(days=9), 0.0) for d in range(3)]
    batches = [rows[:50], [*rows[50:], late], end]  # a version that comes after the events it holds for
    for batch in batches:
        write(spark, tmp_path / "in", batch)
    for _ in range(2):
        stream = reader(spark, tmp_path / "in").withColumnRenamed("user_id", "device_id")
        found = keyed.in_force(
            stream.where("event_type = 'view'"), stream.where("event_type = 'signup'"), "12 hours"
        )
        jobs.continued(found, str(tmp_path / "out"), str(tmp_path / "state"))
    every = [*rows, late]
    versions = sorted((r[1], r[3], r[0]) for r in every if r[2] == "signup")
    want = {
        r[0]: max(((t, i) for d, t, i in versions if d == r[1] and t <= r[3]), default=(None, None))[1]
        for r in every if r[2] == "view"
    }
    got = [(r["event_id"], r["version_id"]) for r in read(spark, tmp_path / "out").collect()]
    assert len(got) == len(dict(got)) and dict(got) == want and 900 in want.values()


def test_the_log_is_read_once_whatever_was_sent_twice(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = lambda a, b: spark.range(a, b).select(
        (F.col("id") % 5).alias("device_id"), F.col("id").alias("seq"), (F.col("id") * MINUTE + BASE).alias("us"),
        (F.col("id") / 2).alias("value"), F.lit("vib").alias("channel")
    )
    segments.append(rows(0, 100), log, 3)
    segments.append(rows(50, 150), log, 3)  # half of it again

    def run():
        once = jobs.deduplicated(segments.segment_stream(spark, log), ["device_id", "seq"])
        jobs.continued(once.drop("ts"), str(tmp_path / "out"), str(tmp_path / "state"))

    run()
    assert read(spark, tmp_path / "out").count() == 150
    segments.append(rows(120, 200), log, 3)
    run()
    run()
    got = read(spark, tmp_path / "out").collect()
    assert sorted(r["seq"] for r in got) == list(range(200))
    assert all(r["value"] == r["seq"] / 2 and r["us"] == r["seq"] * MINUTE + BASE and r["channel"] == "vib" for r in got)
    assert {(r["device_id"], r["log_partition"]) for r in got} == {
        (d, p) for d, p in {(r["device_id"], r["log_partition"]) for r in got}
    } and len({r["device_id"] for r in got}) == 5
    # a record that is only half written is not there yet
    segment = next(p for p in (tmp_path / "log").rglob("*.seg"))
    with open(segment, "ab") as f:
        f.write(b"x" * 10)
    ends = segments.SegmentReader({"path": log}).latestOffset()
    assert all(v % segments.RECORD.itemsize == 0 for v in ends.values())


def test_shares_of_a_batch_cover_it_once(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "log")
    segments.append(
        spark.range(1000).selectExpr("id % 7 device_id", "id seq", "id us", "1.0D value", "'c' channel"), log, 2
    )
    monkeypatch.setattr(segments, "SHARE", 64)
    source = segments.SegmentReader({"path": log})
    end = source.latestOffset()
    middle = {p: v // 2 // segments.RECORD.itemsize * segments.RECORD.itemsize for p, v in end.items()}
    found = []
    for a, b in (({}, middle), (middle, end)):
        for share in source.partitions(a, b):
            found += next(source.read(share)).column(1).to_pylist()
    assert sorted(found) == list(range(1000))


def test_a_batch_that_was_cut_off_takes_effect_once(spark, tmp_path):
    sink = LedgerSink(spark, str(tmp_path / "alerts"))
    rows = lambda ids, v: spark.createDataFrame([(i, v, f"a{i}v{v}") for i in ids], "id int, version int, text string")
    schema = rows([0], 0).schema
    assert sink.rows(schema).collect() == []
    assert sink.commit(rows(range(5), 1), 0)

    @F.udf("string")
    def dies(text):
        if text.startswith("a3"):
            raise RuntimeError("lost")
        return text

    with pytest.raises(Exception, match="lost"):
        sink.commit(rows(range(5), 2).repartition(5, "id").withColumn("text", dies("text")), 1)
    assert sink.batches() == [0] and sink.rows(schema).count() == 5
    assert sink.commit(rows(range(2, 5), 2), 1) and not sink.commit(rows(range(2, 5), 2), 1)
    assert sink.batches() == [0, 1] and sink.sweep() >= 1 and sink.sweep() == 0
    got = sorted(tuple(r) for r in sink.latest(schema, ["id"], ["version"]).collect())
    assert got == [(i, 1 if i < 2 else 2, f"a{i}v{1 if i < 2 else 2}") for i in range(5)]


def test_alerts_are_forgotten_in_time(spark, tmp_path):
    """A resolved alert that is heard of again after its time begins anew."""
    at = lambda hours: START + datetime.timedelta(hours=hours)
    schema = "alert_id long, ts timestamp, status string"
    batches = [[(1, at(0), "RESOLVED")], [(2, at(50), "OPEN")], [(2, at(51), "OPEN")], [(1, at(52), "OPEN")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true"
    ).parquet(str(tmp_path / "in"))
    found = jobs.drained(jobs.lifecycle(stream, "1 hour", 10 * 3600 * 1000), "update", ["alert_id"])
    assert {r["alert_id"]: (r["status"], r["illegal"]) for r in found.collect()} == {1: ("OPEN", 0), 2: ("OPEN", 0)}


class Handle:
    """A state handle that counts what it is asked."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def _count(self, value=None):
        self.calls, self.value = self.calls + 1, value

    def get(self):
        self.calls += 1
        return self.value

    update = clear = _count

    def registerTimer(self, due):  # noqa: N802
        self.calls += 1
        self.timers.add(due)

    def deleteTimer(self, due):  # noqa: N802
        self.calls += 1
        self.timers.remove(due)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 0


@pytest.mark.parametrize("processor", [jobs.Escalation([MINUTE, 90 * MINUTE]), keyed.InForce()])
def test_a_device_asks_the_state_store_as_often_whatever_it_holds(processor):
    calls = []
    for n in (1, 200):
        handle = Handle()
        processor.init(handle)
        for start in (0, n):  # a batch and a later one
            us = [(start + i) * MINUTE for i in range(n)]
            frame = pd.DataFrame(
                {"us": us, "event_id": range(start, start + n), "kind": "alert", "is_version": [i % 2 == 1 for i in range(n)]}
            )
            list(processor.handleInputRows((1,), iter([frame]), handle))
        assert len(handle.timers) == 1
        calls.append(handle.calls)
    assert max(calls) <= 7
