"""Streaming forms of the telemetry and alert jobs.

Sources are file streams here; with a broker the same transforms take its stream. Events may be a day
late, so watermarks default to 24 hours; what comes later is for the batch backfill.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener

from tremora.functions.features import features
from tremora.session import scratch
from tremora.sources.objects import put
from tremora.streaming.sink import LedgerSink

LATENESS = "24 hours"
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
BATCH = "__batch"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, time in UTC."""
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        rows = reader.parquet(path)
    else:  # a stream reads folders; the filter sees names of files only
        rows = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(writer: DataStreamWriter, idle: bool = True) -> None:
    """Run a stream over what has come. Processing-time state (``idle`` false) never has its last batch without data,
    so such batches are left out for it; event-time timers need them.
    """
    conf = SparkSession.active().conf
    before = conf.get(NO_DATA)
    conf.set(NO_DATA, str(idle).lower())
    try:
        query = writer.trigger(availableNow=True).start()  # a query keeps the settings it started with
    finally:
        conf.set(NO_DATA, before)
    query.awaitTermination()


def continued(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", idle: bool = True) -> None:
    """Run a stream over what has come since it last ran under this checkpoint, and add what it writes to a table.

    A run that was cut off goes on where it stopped: a batch that is run again takes effect once.
    """
    sink = LedgerSink(stream.sparkSession, out)

    def keep(batch: DataFrame, batch_id: int) -> None:
        if mode == "complete":  # each batch is the whole result
            batch.write.mode("overwrite").parquet(f"{out}/batch=0")
        else:
            sink.commit(batch.withColumn(BATCH, F.lit(batch_id).cast("long")), batch_id)

    finished(stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(keep), idle)


def drained(stream: DataFrame, mode: str = "append", keys: list[str] | None = None, idle: bool = True) -> DataFrame:
    """Run a stream over what there is and return the rows that it wrote, as a table in the shared folder. Of a stream
    in update mode ``keys`` leave the last row of each.
    """
    spark = stream.sparkSession
    out = scratch(spark, "stream")
    continued(stream, out, scratch(spark, "stream-state"), mode, idle)
    sink = LedgerSink(spark, out)
    if keys is None:
        return sink.rows(stream.schema)
    schema = T.StructType([*stream.schema.fields, T.StructField(BATCH, T.LongType())])
    return sink.latest(schema, keys, [BATCH]).drop(BATCH)


def deduplicated(stream: DataFrame, keys: list[str], lateness: str = LATENESS) -> DataFrame:
    """At-least-once delivery made idempotent."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def window_features(stream: DataFrame, width: str, slide: str | None = None, lateness: str = LATENESS) -> DataFrame:
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.withWatermark("ts", lateness).groupBy(
        F.col("event_type").alias("channel"), w.alias("w")
    ).agg(*features(F.col("value")))


def rollup_features(stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Hourly sums merged to days in a second stateful step."""
    hourly = stream.withWatermark("ts", lateness).groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(
        F.count("*").alias("n"), F.sum("value").alias("s"), F.max(F.abs("value")).alias("top")
    )
    return hourly.groupBy("event_type", F.window(F.window_time("w"), "1 day").alias("d")).agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("top").alias("peak")
    )


def enriched(stream: DataFrame, assets: DataFrame, key: str) -> DataFrame:
    """Stream-static join with asset metadata or the latest configuration."""
    return stream.join(assets, key, "left")


def correlated(stream: DataFrame, left: str, right: str, width: str, lateness: str = LATENESS) -> DataFrame:
    """Stream-stream join of two channels of one device within an interval."""
    a = stream.where(F.col("event_type") == left).select(
        "user_id", F.col("ts").alias("a_ts"), F.col("event_id").alias("a_id")
    ).withWatermark("a_ts", lateness)
    b = stream.where(F.col("event_type") == right).select(
        F.col("user_id").alias("b_user"), F.col("ts").alias("b_ts"), F.col("event_id").alias("b_id")
    ).withWatermark("b_ts", lateness)
    near = F.expr(f"user_id = b_user and b_ts between a_ts - interval {width} and a_ts + interval {width}")
    return a.join(b, near).select("user_id", "a_id", "b_id")


class Throttle(StatefulProcessor):
    """Emits an alert unless one was emitted within the quiet time before. A device's state goes once the watermark
    has passed its quiet time.
    """

    def __init__(self, quiet_us: int):
        self.quiet_us = quiet_us

    def _due(self, us: int) -> int:
        return (us + self.quiet_us) // 1000 + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField("us", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = sorted(t for frame in rows for t in frame["us"].tolist())
        last = self.last.get()[0] if self.last.exists() else None
        out, before = [], last
        for t in times:
            if last is None or t - last >= self.quiet_us:
                out.append(t)
                last = t
        if last != before:
            if before is not None:
                self.handle.deleteTimer(self._due(before))
            self.last.update((last,))
            self.handle.registerTimer(self._due(last))
        yield pd.DataFrame({"device_id": [key[0]] * len(out), "us": out}).astype({"device_id": "int64", "us": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        yield pd.DataFrame({"device_id": [], "us": []}).astype("int64")

    def close(self) -> None:
        pass


class Lifecycle(StatefulProcessor):
    """Follows the state of an alert; a step back is counted and ignored. An alert is forgotten once the watermark is
    ``ttl_ms`` beyond what was last heard of it.
    """

    RANK = {"OPEN": 0, "ACKNOWLEDGED": 1, "RESOLVED": 2}

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = (("rank", T.IntegerType()), ("illegal", T.LongType()), ("due", T.LongType()))
        self.state = handle.getValueState("state", T.StructType([T.StructField(n, t) for n, t in fields]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rank, illegal, due = self.state.get() if self.state.exists() else (-1, 0, 0)
        steps = sorted(
            (us, self.RANK[s])
            for frame in rows
            for us, s in zip(frame["us"].tolist(), frame["status"].tolist(), strict=True)
        )
        for _, step in steps:
            illegal += step < rank
            rank = max(rank, step)
        later = max(due, steps[-1][0] // 1000 + self.ttl_ms)
        if later > due:
            if due:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(later)
        self.state.update((rank, illegal, later))
        name = next(n for n, r in self.RANK.items() if r == rank)
        yield pd.DataFrame(
            {"alert_id": [key[0]], "status": [name], "illegal": [illegal]}
        ).astype({"alert_id": "int64", "illegal": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield pd.DataFrame({"alert_id": [], "status": [], "illegal": []}).astype(
            {"alert_id": "int64", "status": "object", "illegal": "int64"}
        )

    def close(self) -> None:
        pass


class Heartbeat(StatefulProcessor):
    """Reports a device once its silence passes the limit, by an event-time timer."""

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("ms", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = max(t for frame in rows for t in frame["ms"].tolist())
        if self.seen.exists():
            before = self.seen.get()[0]
            self.handle.deleteTimer(before + self.limit_ms)
            last = max(last, before)
        self.seen.update((last,))
        self.handle.registerTimer(last + self.limit_ms)
        yield pd.DataFrame({"device_id": [], "last_ms": []}).astype("int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.seen.get()[0]
        self.seen.clear()  # it is reported once; what it sends later begins anew
        yield pd.DataFrame({"device_id": [key[0]], "last_ms": [last]}).astype("int64")

    def close(self) -> None:
        pass


class Escalation(StatefulProcessor):
    """Raises an alert a level at each step of time without an acknowledgement, by event-time timers. A device whose
    rules came as initial state follows these, others the given steps. What a device holds is one value, with the one
    timer of the level that is due first.
    """

    def __init__(self, steps_us: list[int]):
        self.usual = self.steps_us = steps_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        longs = T.ArrayType(T.LongType())
        # the rules by level, and the alerts that wait: which, when, and the next level
        fields = [(n, longs) for n in ("rule", "after_us", "id", "us", "level")] + [("due", T.LongType())]
        self.state = handle.getValueState("held", T.StructType([T.StructField(n, t) for n, t in fields]))

    def _held(self) -> tuple[list, dict, int | None]:
        """The rules, the alerts that wait, and the timer; the steps of this device are in force from here on."""
        rule, after, alert, us, level, due = self.state.get() or ((), (), (), (), (), None)
        rules = sorted(zip(rule, after, strict=True))
        self.steps_us = [x for _, x in rules] or self.usual
        return rules, dict(zip(alert, zip(us, level, strict=True), strict=True)), due

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        rules, waiting, due = self._held()
        rules += zip(initialState["level"].tolist(), initialState["after_us"].tolist(), strict=True)
        self._keep(rules, waiting, due, due)

    def _raise(self, waiting: dict, until: int, out: list) -> None:
        """Levels that fall due up to a time."""
        for alert, (us, level) in list(waiting.items()):
            while level <= len(self.steps_us) and us + self.steps_us[level - 1] <= until:
                out.append((alert, level))
                level += 1
            if level > len(self.steps_us):
                del waiting[alert]
            else:
                waiting[alert] = us, level

    def _keep(self, rules: list, waiting: dict, later: int | None, due: int | None) -> None:
        if later != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if later is not None:
                self.handle.registerTimer(later)
        if rules or waiting:
            alerts = [(alert, *state) for alert, state in waiting.items()]
            columns = [[x[k] for x in rules] for k in (0, 1)] + [[x[k] for x in alerts] for k in (0, 1, 2)]
            self.state.update((*columns, later))
        else:
            self.state.clear()

    def _due(self, waiting: dict) -> int | None:
        return min(((us + self.steps_us[level - 1]) // 1000 + 1 for us, level in waiting.values()), default=None)

    @staticmethod
    def _frame(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["alert_id", "level"]).astype({"alert_id": "int64", "level": "int32"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (rules, waiting, due), out = self._held(), []
        events = sorted(
            (us, kind, i)
            for frame in rows
            for us, kind, i in zip(
                frame["us"].tolist(), frame["kind"].tolist(), frame["event_id"].tolist(), strict=True
            )
        )
        for us, kind, i in events:
            if kind == "ack":
                self._raise(waiting, us - 1, out)  # an acknowledgement in the same instant is in time
                waiting = {k: v for k, v in waiting.items() if v[0] >= us}
            elif kind == "alert":
                waiting[i] = us, 1
        if events:
            self._raise(waiting, events[-1][0], out)
        self._keep(rules, waiting, self._due(waiting), due)
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (rules, waiting, _), out = self._held(), []
        self._raise(waiting, timerValues.getCurrentWatermarkInMs() * 1000, out)
        self._keep(rules, waiting, self._due(waiting), None)  # the timer that fired is gone
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass


class Progress(StreamingQueryListener):
    """Writes what each batch of the streams reports as a row of a table: rows read, rows a second, and observed
    metrics by name.
    """

    SCHEMA = "run string, batch long, rows long, per_second double, observed map<string, map<string, string>>"

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        row = {
            "run": str(p.runId),
            "batch": p.batchId,
            "rows": p.numInputRows,
            "per_second": p.processedRowsPerSecond,
            "observed": {
                k: {n: None if x is None else str(x) for n, x in v.asDict().items()} for k, v in p.observedMetrics.items()
            }
        }
        put(f"{self.folder}/{p.runId}-{p.batchId}.json", json.dumps(row).encode())

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.SCHEMA).json(self.folder)


def with_state(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def throttled(stream: DataFrame, quiet_us: int, lateness: str = LATENESS) -> DataFrame:
    with_state(stream.sparkSession)
    rows = stream.withWatermark("ts", lateness).select(
        F.col("user_id").alias("device_id"), F.unix_micros("ts").alias("us"), "ts"
    )
    return rows.groupBy("device_id").transformWithStateInPandas(
        Throttle(quiet_us), "device_id long, us long", "Append", "EventTime"
    )


def lifecycle(stream: DataFrame, lateness: str = LATENESS, ttl_ms: int = 90 * 24 * 3600 * 1000) -> DataFrame:
    """From a stream of (alert_id, ts, status): the state after each batch."""
    with_state(stream.sparkSession)
    rows = stream.withWatermark("ts", lateness).select("alert_id", F.unix_micros("ts").alias("us"), "status", "ts")
    return rows.groupBy("alert_id").transformWithStateInPandas(
        Lifecycle(ttl_ms), "alert_id long, status string, illegal long", "Update", "EventTime"
    )


def silent(stream: DataFrame, limit_ms: int, lateness: str = "0 seconds") -> DataFrame:
    """Devices whose silence passed the limit, by event time."""
    with_state(stream.sparkSession)
    rows = stream.withWatermark("ts", lateness).select(
        F.col("user_id").alias("device_id"), F.unix_millis("ts").alias("ms"), "ts"
    )
    return rows.groupBy("device_id").transformWithStateInPandas(
        Heartbeat(limit_ms), "device_id long, last_ms long", "Append", "EventTime"
    )


def scored(stream: DataFrame, score: Callable[[pd.DataFrame], pd.Series], schema: str) -> DataFrame:
    """An in-process model over Arrow batches of the stream."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(score=score(frame))

    return stream.mapInPandas(run, schema)


def escalated(
    stream: DataFrame, steps_us: list[int], lateness: str = LATENESS, rules: DataFrame | None = None
) -> DataFrame:
    """(alert_id, level) as alerts (kind "alert") stay without an acknowledgement (kind "ack") of their device.
    ``rules`` (device_id, level, after_us) is the state that devices begin with.
    """
    with_state(stream.sparkSession)
    rows = stream.withWatermark("ts", lateness).select(
        F.col("user_id").alias("device_id"), F.unix_micros("ts").alias("us"), "kind", "event_id", "ts"
    )
    begin = None if rules is None else rules.select("device_id", "level", "after_us").groupBy("device_id")
    return rows.groupBy("device_id").transformWithStateInPandas(
        Escalation(steps_us), "alert_id long, level int", "Append", "EventTime", initialState=begin
    )


def observed(stream: DataFrame, name: str) -> DataFrame:
    """The stream with counts that a ``Progress`` listener sees for each batch."""
    return stream.observe(
        name,
        F.count("*").alias("n"),
        F.count_if(F.col("value").isNull() | (F.col("value") < 0)).alias("bad"),
        F.max("ts").cast("string").alias("latest")
    )
