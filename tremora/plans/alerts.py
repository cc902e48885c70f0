"""Alert queries: filters, routing, suppression, lifecycle, thresholds and state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tremora.functions.features import tidy
from tremora.operators import alerts as A
from tremora.operators.ranks import numbered
from tremora.plans.registry import events, query, stamp
from tremora.session import table

QUIET = 15 * 60 * 1_000_000
_SEVERITY = "CASE WHEN value >= 250 THEN 'P1' WHEN value >= 120 THEN 'P2' ELSE 'P3' END"


def _errors(spark, sf_dir):
    return events(spark, sf_dir).where("event_type = 'error'").withColumn("us", F.unix_micros("ts"))


@query(
    "alert_filter_sorted",
    f"""SELECT event_id AS alert_id, user_id AS device_id, {_SEVERITY} AS severity, value, row_number() OVER (ORDER BY {_SEVERITY}, ts, event_id) AS place
FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-10' AND value >= 120 QUALIFY place <= 500""",
)
def alert_filter_sorted(spark, sf_dir):
    """The first page of alerts by severity, then time."""
    rows = table(spark, sf_dir, "events").where(
        "event_type = 'error' and ts >= timestamp_ntz'2024-01-10' and value >= 120"
    ).withColumn("severity", A.severity(F.col("value")))
    page = rows.orderBy("severity", "ts", "event_id").limit(500)
    place = F.row_number().over(Window.orderBy("severity", "ts", "event_id")).cast("long")
    return page.select(
        F.col("event_id").alias("alert_id"),
        F.col("user_id").alias("device_id"),
        "severity",
        "value",
        place.alias("place")
    )


@query(
    "alert_severity_routing",
    f"""SELECT {_SEVERITY} AS severity, CASE WHEN value >= 250 THEN 'pager' WHEN value >= 120 THEN 'email' ELSE 'dashboard' END AS channel, count(*) AS n
FROM events WHERE event_type = 'error' GROUP BY ALL""",
)
def alert_severity_routing(spark, sf_dir):
    level = A.severity(F.col("value"))
    return _errors(spark, sf_dir).groupBy(
        level.alias("severity"), A.route(level).alias("channel")
    ).agg(F.count("*").alias("n"))


@query(
    "alert_dedup_throttle_15m",
    """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us FROM events),
k AS (SELECT user_id, min(us) AS us FROM e GROUP BY user_id
  UNION ALL SELECT k.user_id, (SELECT min(e.us) FROM e WHERE e.user_id = k.user_id AND e.us >= k.us + 900000000) AS us FROM k WHERE k.us IS NOT NULL)
SELECT user_id AS device_id, count(us) AS emitted, max(us) AS last_us FROM k WHERE us IS NOT NULL GROUP BY user_id""",
)
def alert_dedup_throttle_15m(spark, sf_dir):
    """Alerts emitted when none was in the 15 minutes before."""
    rows = events(spark, sf_dir).select(F.col("user_id").alias("device_id"), F.unix_micros("ts").alias("us"))
    return A.throttle(rows, "device_id", "us", QUIET).groupBy("device_id").agg(
        F.count("*").alias("emitted"), F.max("us").alias("last_us")
    )


@query(
    "alert_dedup_quiet_15m",
    """WITH g AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)
SELECT user_id AS device_id, count(*) AS bursts FROM g WHERE before IS NULL OR epoch_us(ts) - epoch_us(before) > 900000000 GROUP BY user_id""",
)
def alert_dedup_quiet_15m(spark, sf_dir):
    """Bursts: an alert counts if the device was silent for over 15 minutes."""
    rows = events(spark, sf_dir).select(F.col("user_id").alias("device_id"), F.unix_micros("ts").alias("us"))
    return A.quiet_groups(rows, "device_id", "us", QUIET).groupBy("device_id").agg(F.count("*").alias("bursts"))


@query(
    "alert_lifecycle_latest",
    """WITH o AS (SELECT *, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 WHEN 'F' THEN 2 END AS r FROM orders),
b AS (SELECT *, lag(r) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM o)
SELECT o_custkey AS asset_id, arg_max(o_orderstatus, struct_pack(a := o_orderdate, b := o_orderkey)) AS latest, coalesce(count(*) FILTER (WHERE r < p), 0) AS illegal, count(*) AS transitions FROM b GROUP BY o_custkey""",
)
def alert_lifecycle_latest(spark, sf_dir):
    """Latest status of each asset and steps that went back in the order open, acknowledged, resolved."""
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "asset_id")
    return A.lifecycle(rows, "asset_id", "o_orderstatus", ["o_orderdate", "o_orderkey"], {"O": 0, "P": 1, "F": 2})


@query(
    "heartbeat_gaps",
    """WITH g AS (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)
SELECT user_id AS device_id, count(*) FILTER (WHERE gap > 43200000000) AS silences, max(gap) AS longest_us FROM g GROUP BY user_id""",
)
def heartbeat_gaps(spark, sf_dir):
    """Silences of over 12 hours, and the longest."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros("ts")
    gap = us - F.lag(us).over(w)
    return events(spark, sf_dir).withColumn("gap", gap).groupBy(F.col("user_id").alias("device_id")).agg(
        F.count_if(F.col("gap") > 12 * 3600 * 1_000_000).alias("silences"), F.max("gap").alias("longest_us")
    )


@query(
    "sequence_gaps",
    "SELECT user_id AS device_id, max(event_id) - min(event_id) + 1 - count(DISTINCT event_id) AS lost FROM events GROUP BY user_id",
)
def sequence_gaps(spark, sf_dir):
    """Sequence numbers that never came."""
    return events(spark, sf_dir).groupBy(F.col("user_id").alias("device_id")).agg(
        (F.max("event_id") - F.min("event_id") + 1 - F.countDistinct("event_id")).alias("lost")
    )


@query(
    "cusum",
    """WITH s AS (SELECT *, sum(value - 105.0) OVER w AS c FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, c - least(0, min(c) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS x FROM s)
SELECT event_type AS channel, strftime(ts, '%Y-%m-%d') AS day, round(max(x), 4) + 0.0 AS top FROM m GROUP BY ALL""",
)
def cusum(spark, sf_dir):
    rows = A.cusum(
        events(spark, sf_dir), ["event_type"], ["ts", "event_id"], F.col("value"), 105.0, F.date_trunc("day", "ts")
    )
    return rows.groupBy(
        F.col("event_type").alias("channel"), F.date_format("ts", "yyyy-MM-dd").alias("day")
    ).agg(tidy(F.max("cusum"), 4).alias("top"))


@query(
    "hysteresis_alarm",
    """WITH x AS (SELECT *, CASE WHEN value > 200 THEN 1 WHEN value < 50 THEN 0 END AS c FROM events),
y AS (SELECT *, coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS alarm FROM x)
SELECT user_id AS device_id, CAST(sum(alarm) AS BIGINT) AS on_rows, count(*) AS n FROM y GROUP BY user_id""",
)
def hysteresis_alarm(spark, sf_dir):
    rows = A.hysteresis(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value", 200.0, 50.0)
    return rows.groupBy(F.col("user_id").alias("device_id")).agg(
        F.sum("alarm").alias("on_rows"), F.count("*").alias("n")
    )


@query(
    "consecutive_failures",
    """WITH x AS (SELECT *, event_type IN ('error', 'view') AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type IN ('error', 'view') ORDER BY ts, event_id) AS i FROM events),
g AS (SELECT user_id, i, count(*) AS n FROM x WHERE f GROUP BY ALL)
SELECT user_id AS device_id, max(n) AS longest, count(*) FILTER (WHERE n > 3) AS fallbacks FROM g GROUP BY user_id""",
)
def consecutive_failures(spark, sf_dir):
    """Longest run of failures, and runs of more than three."""
    runs = A.islands(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("event_type").isin("error", "view"))
    return runs.groupBy(F.col("user_id").alias("device_id")).agg(
        F.max("length").alias("longest"), F.count_if(F.col("length") > 3).alias("fallbacks")
    )


@query(
    "escalation_gate",
    "SELECT count(*) AS tier1, count(*) FILTER (WHERE value > 120) AS tier2, count(*) FILTER (WHERE value > 250) AS tier3 FROM events WHERE event_type <> 'signup'",
)
def escalation_gate(spark, sf_dir):
    """How many rows reach each tier: later tiers see only what passed the cheaper gates."""
    rows = events(spark, sf_dir).where("event_type <> 'signup'")
    return rows.agg(
        F.count("*").alias("tier1"),
        F.count_if(F.col("value") > 120).alias("tier2"),
        F.count_if(F.col("value") > 250).alias("tier3")
    )


@query(
    "rate_limit_1m",
    "SELECT user_id AS device_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, count(*) AS requests FROM events GROUP BY ALL HAVING count(*) > 1",
)
def rate_limit_1m(spark, sf_dir):
    """Keys with more than one request within a minute."""
    return events(spark, sf_dir).groupBy(
        F.col("user_id").alias("device_id"), stamp(F.date_trunc("minute", "ts")).alias("minute")
    ).agg(F.count("*").alias("requests")).where("requests > 1")


@query(
    "priority_queue",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, CAST(row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, ts, event_id) AS BIGINT) AS place FROM events""",
)
def priority_queue(spark, sf_dir):
    """Order of sending: alerts, then status, then telemetry, by day. Each level and hour is numbered on its own."""
    level = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    rows = events(spark, sf_dir).select("event_id", "ts", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return numbered(
        rows, ["day"], [level, F.hour("ts")], ["ts", "event_id"], "place"
    ).select("day", "event_id", "place")
