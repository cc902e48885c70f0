"""Alerts: severity, routing, suppression, lifecycle, gaps and hysteresis."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora.operators.temporal import asof

P1, P2 = 250.0, 120.0


def severity(value: Column, p1: float = P1, p2: float = P2) -> Column:
    return F.when(value >= p1, "P1").when(value >= p2, "P2").otherwise("P3")


def route(level: Column) -> Column:
    return F.when(level == "P1", "pager").when(level == "P2", "email").otherwise("dashboard")


def throttle(alerts: DataFrame, device: str, time_us: str, quiet_us: int) -> DataFrame:
    """Emitted alerts of each device: an alert is suppressed within ``quiet_us`` of the last emitted one.

    The rows of each device are folded in order of time, with its last emitted time as the only state.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, begun = None, 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            own, times = batch.column(0), batch.column(1).to_numpy()
            runs = pc.run_end_encode(own)  # rows of one device stand together
            kept, start = [], 0
            for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if begun and name == held:
                    at = start + int(np.searchsorted(times[start:end], last + quiet_us))
                else:
                    at = start
                while at < end:  # from an emitted alert straight to the next that may be
                    kept.append(at)
                    last = int(times[at])
                    at = max(at + 1, start + int(np.searchsorted(times[start:end], last + quiet_us)))
                held, begun, start = name, True, end
            yield batch.take(pa.array(kept, pa.int64()))

    rows = alerts.select(device, F.col(time_us).cast("long").alias(time_us)).where(F.col(time_us).isNotNull())
    return rows.repartition(device).sortWithinPartitions(device, time_us).mapInArrow(fold, rows.schema)


def quiet_groups(alerts: DataFrame, device: str, time_us: str, quiet_us: int) -> DataFrame:
    """First alert of each burst: an alert opens a burst after more than ``quiet_us`` without any."""
    w = Window.partitionBy(device).orderBy(time_us)
    return alerts.withColumn(
        "__gap", F.col(time_us) - F.lag(time_us).over(w)
    ).where("__gap is null or __gap > %d" % quiet_us).drop("__gap")


def hysteresis(rows: DataFrame, device: list[str], order: list[str], value: str, up: float, down: float) -> DataFrame:
    """Add ``alarm``: on from a value above ``up`` until one below ``down``."""
    w = Window.partitionBy(*device).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    crossing = F.when(F.col(value) > up, 1).when(F.col(value) < down, 0)
    return rows.withColumn("alarm", F.coalesce(F.last(crossing, ignorenulls=True).over(w), F.lit(0)))


def cusum(
    rows: DataFrame, device: list[str], order: list[str], x: Column, slack: float, block: Column | None = None
) -> DataFrame:
    """Add ``cusum``: max(0, previous + x - slack), from running sums and their running minimum.

    ``block`` cuts a device's time into parts that are summed on their own; each part is then moved by the sum of the
    parts before it and compared with their minimum, so no task holds a device's whole history.
    """
    keys, block = [*device, "__block"], F.lit(0) if block is None else block
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("__block", block).withColumn("__sum", F.sum(x - F.lit(slack)).over(w))
    summed = summed.withColumn("__least", F.min("__sum").over(w))
    parts = summed.groupBy(*keys).agg(
        F.max_by("__sum", F.struct(*order)).alias("__total"), F.min("__sum").alias("__low")
    )
    before = Window.partitionBy(*device).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__base", F.coalesce(F.sum("__total").over(before), F.lit(0.0)))
    parts = parts.withColumn(
        "__floor", F.coalesce(F.min(F.col("__base") + F.col("__low")).over(before), F.lit(0.0))
    ).select(*keys, "__base", "__floor")
    level = F.least(F.lit(0.0), F.col("__floor"), F.col("__base") + F.col("__least"))
    return summed.join(parts, keys).withColumn("cusum", F.col("__base") + F.col("__sum") - level).drop(
        "__sum", "__least", "__base", "__floor", "__block"
    )


def islands(rows: DataFrame, device: list[str], order: list[str], flag: Column) -> DataFrame:
    """Runs of consecutive flagged rows: device, first and last time, length."""
    w = Window.partitionBy(*device).orderBy(*order)
    marked = rows.withColumn("__flag", flag)
    number = F.row_number().over(w) - F.row_number().over(Window.partitionBy(*device, "__flag").orderBy(*order))
    return marked.withColumn("__island", number).where("__flag").groupBy(*device, "__island").agg(
        F.min(order[0]).alias("first_ts"), F.max(order[0]).alias("last_ts"), F.count("*").alias("length")
    ).drop("__island")


def lifecycle(events: DataFrame, alert: str, state: str, order: list[str], ranks: dict[str, int]) -> DataFrame:
    """Latest state of each alert, and how many transitions went backwards."""
    rank = F.coalesce(*(F.when(F.col(state) == s, F.lit(r)) for s, r in ranks.items()))
    w = Window.partitionBy(alert).orderBy(*order)
    steps = events.withColumn("__rank", rank).withColumn(
        "__back", (F.col("__rank") < F.lag("__rank").over(w)).cast("long")
    )
    return steps.groupBy(alert).agg(
        F.max_by(state, F.struct(*order)).alias("latest"),
        F.coalesce(F.sum("__back"), F.lit(0)).alias("illegal"),
        F.count("*").alias("transitions")
    )


def escalation(
    alerts: DataFrame, acks: DataFrame, seen: DataFrame, rules: DataFrame, device: str, alert: str, us: str, width_us: int
) -> DataFrame:
    """(alert, level): the levels of ``rules`` (site, level, after_us) that each alert (device, alert, us, site)
    reached before a later acknowledgement (device, us) of its device, as far as ``seen`` (device, seen) goes.

    The acknowledgement is joined as of reversed time, by blocks: a device of any length costs a sort.
    """
    back = alerts.withColumn("__on", -F.col(us))
    later = acks.select(device, (1 - F.col(us)).alias("__on"), F.col(us).alias("__acked"))
    found = asof(back, later, [device], "__on", ["__acked"], width=width_us)
    due = found.join(seen, device).join(rules, "site").withColumn("__due", F.col(us) + F.col("after_us"))
    open_then = F.col("__acked").isNull() | (F.col("__acked") > F.col("__due"))
    return due.where((F.col("__due") <= F.col("seen")) & open_then).select(alert, "level")
