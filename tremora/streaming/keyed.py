"""Keyed processors with more than one kind of row: captures around triggers, and configuration in force."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tremora.streaming.jobs import LATENESS, with_state


class Capture(StatefulProcessor):
    """Gives out the rows of a device within ``width_us`` before and after each of its triggers.

    Two ring buffers hold what may still meet: rows and triggers that are not older than the width and the lateness
    before the newest row. A row that comes late, in this batch or a later one, meets the triggers that are held, and a
    late trigger the rows. Rings of a device that fell silent go with their time to live.
    """

    def __init__(self, width_us: int, late_us: int, ttl_ms: int):
        self.width_us, self.late_us, self.ttl_ms = width_us, late_us, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        long, double = T.LongType(), T.DoubleType()
        row = T.StructType([T.StructField("us", long), T.StructField("id", long), T.StructField("value", double)])
        mark = T.StructType([T.StructField("us", long), T.StructField("id", long)])
        self.ring = handle.getListState("ring", row, self.ttl_ms)
        self.marks = handle.getListState("marks", mark, self.ttl_ms)

    @staticmethod
    def _pairs(triggers: list[tuple], rows: list[tuple], width: int) -> Iterator[tuple]:
        """(trigger, row) within the width; ``rows`` are in order of time."""
        times = [r[0] for r in rows]
        for us, trigger in triggers:
            for at in range(np.searchsorted(times, us - width), np.searchsorted(times, us + width, side="right")):
                yield trigger, rows[at][1], rows[at][0], rows[at][2]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ring = [tuple(r) for r in self.ring.get()] if self.ring.exists() else []
        marks = [tuple(r) for r in self.marks.get()] if self.marks.exists() else []
        for frame in rows:
            new = sorted(zip(frame["us"].tolist(), frame["event_id"].tolist(), frame["value"].tolist(), strict=True))
            fired = frame[frame["fired"]]
            more = list(zip(fired["us"].tolist(), fired["event_id"].tolist(), strict=True))
            out = [*self._pairs(marks, new, self.width_us), *self._pairs(more, sorted(ring + new), self.width_us)]
            ring, marks = ring + new, marks + more
            old = max(r[0] for r in ring) - self.late_us - self.width_us
            ring, marks = [r for r in ring if r[0] >= old], [m for m in marks if m[0] >= old]
            yield pd.DataFrame(out, columns=["trigger_id", "event_id", "us", "value"]).astype(
                {"trigger_id": "int64", "event_id": "int64", "us": "int64", "value": "float64"}
            )
        for state, held in ((self.ring, ring), (self.marks, marks)):
            state.put(held) if held else state.clear()

    def close(self) -> None:
        pass


def captured(
    stream: DataFrame, fired, width_us: int, late_us: int = 24 * 3600 * 1_000_000, ttl_ms: int = 48 * 3600 * 1000
) -> DataFrame:
    """(trigger_id, event_id, us, value): what each device sent around its rows for which ``fired`` holds; rows without
    a time or an id are left out. The rings'
    time to live is processing time: run it with a steady trigger, or with ``idle=False`` over what there is.
    """
    with_state(stream.sparkSession)
    rows = stream.where("ts is not null and event_id is not null").select(
        F.col("user_id").alias("device_id"),
        F.unix_micros("ts").alias("us"),
        "event_id",
        F.col("value").cast("double").alias("value"),
        F.coalesce(fired, F.lit(False)).alias("fired")
    )
    return rows.groupBy("device_id").transformWithStateInPandas(
        Capture(width_us, late_us, ttl_ms),
        "trigger_id long, event_id long, us long, value double",
        "Append",
        "ProcessingTime"
    )


class InForce(StatefulProcessor):
    """Gives each event the version of the configuration that is valid at its event time.

    An event waits until the watermark has passed its time, since a version from before may still come; then it takes
    the last version at or before it. Of the versions that the watermark has passed only the last is kept. What a device
    holds is one value with its one timer in it, so a batch asks the state store as often whatever a device holds.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        longs = T.ArrayType(T.LongType())
        fields = (("version_us", longs), ("version_id", longs), ("us", longs), ("id", longs), ("due", T.LongType()))
        self.state = handle.getValueState("held", T.StructType([T.StructField(n, t) for n, t in fields]))

    def _given_out(
        self, versions: list, waiting: list, due: int | None, watermark_ms: int, fired: bool
    ) -> Iterator[pd.DataFrame]:
        versions.sort()
        times, out, left = [v[0] for v in versions], [], []
        for us, event in waiting:
            if us // 1000 + 1 <= watermark_ms:
                at = bisect_right(times, us)
                out.append((event, versions[at - 1][1] if at else None))
            else:
                left.append((us, event))
        passed = bisect_right(times, watermark_ms * 1000)
        versions = versions[max(passed - 1, 0) :]
        later = min(left)[0] // 1000 + 1 if left else None
        if later != due:
            if due is not None and not fired:  # a timer that fired is gone
                self.handle.deleteTimer(due)
            if later is not None:
                self.handle.registerTimer(later)
        if versions or left:
            columns = [[x[k] for x in held] for held in (versions, left) for k in (0, 1)]
            self.state.update((*columns, later))
        else:
            self.state.clear()
        if out:
            yield pd.DataFrame(out, columns=["event_id", "version_id"]).astype(
                {"event_id": "int64", "version_id": "Int64"}
            )

    def _held(self) -> tuple[list, list, int | None]:
        version_us, version_id, us, event, due = self.state.get() or ((), (), (), (), None)
        return list(zip(version_us, version_id, strict=True)), list(zip(us, event, strict=True)), due

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        versions, waiting, due = self._held()
        for frame in rows:
            for us, event, is_version in zip(
                frame["us"].tolist(), frame["event_id"].tolist(), frame["is_version"].tolist(), strict=True
            ):
                (versions if is_version else waiting).append((us, event))
        yield from self._given_out(versions, waiting, due, timerValues.getCurrentWatermarkInMs(), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._given_out(*self._held(), timerValues.getCurrentWatermarkInMs(), True)

    def close(self) -> None:
        pass


def in_force(events: DataFrame, versions: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """(event_id, version_id): two streams of (device_id, ts, event_id) joined in event time, late versions included;
    version_id is null before a device's first version. Rows without a time or an id are left out.
    """
    with_state(events.sparkSession)
    side = lambda s, flag: s.where("ts is not null and event_id is not null").select("device_id", "ts", "event_id", F.lit(flag).alias("is_version"))
    rows = side(events, False).union(side(versions, True)).withWatermark("ts", lateness).select(
        "device_id", F.unix_micros("ts").alias("us"), "event_id", "is_version", "ts"
    )
    return rows.groupBy("device_id").transformWithStateInPandas(
        InForce(), "event_id long, version_id long", "Append", "EventTime"
    )
