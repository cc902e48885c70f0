"""Streaming queries, run over the events table and compared with their batch forms."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import functions as F

from tremora.functions.features import tidy
from tremora.plans import features, operations  # noqa: F401  register the batch forms
from tremora.plans.alerts import QUIET
from tremora.plans.records import ESCALATION_RULES_SQL, ESCALATION_SQL, MINUTE, escalation_rules
from tremora.plans.registry import SQL, events, query, stamp
from tremora.session import scratch, table
from tremora.sources.objects import put
from tremora.streaming import jobs, keyed, segments
from tremora.streaming.sink import LedgerSink


@query(
    "stream_features_sliding",
    f"""SELECT * FROM ({SQL["window_features_sliding"]}) WHERE CAST(window_start AS TIMESTAMP) + INTERVAL 5 MINUTES <= (SELECT max(ts) - INTERVAL 24 HOURS FROM events)""",
)
def stream_features_sliding(spark, sf_dir):
    """The sliding-window job as a stream in append mode: windows are given out once the watermark has passed them,
    and their state goes.
    """
    out = jobs.drained(jobs.window_features(jobs.event_stream(spark, sf_dir), "5 minutes", "1 minute"))
    return out.withColumn("window_start", stamp(F.col("w.start"))).drop("w")


@query("stream_alert_throttle", SQL["alert_dedup_throttle_15m"])
def stream_alert_throttle(spark, sf_dir):
    """Suppression with the last emitted time as keyed state."""
    out = jobs.drained(jobs.throttled(jobs.event_stream(spark, sf_dir), QUIET))
    return out.groupBy("device_id").agg(F.count("*").alias("emitted"), F.max("us").alias("last_us"))


@query(
    "stream_interval_join",
    "SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000 WHERE a.event_type = 'view' AND b.event_type = 'error'"
)
def stream_interval_join(spark, sf_dir):
    """Two channels joined within an hour, both with watermarks."""
    return jobs.drained(jobs.correlated(jobs.event_stream(spark, sf_dir), "view", "error", "1 hour"))


@query("stream_dedup_idempotent", "SELECT event_type AS channel, count(*) AS n FROM events GROUP BY event_type")
def stream_dedup_idempotent(spark, sf_dir):
    """Every row delivered twice counts once."""
    once = jobs.event_stream(spark, sf_dir)
    twice = once.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return jobs.drained(
        jobs.deduplicated(twice, ["user_id", "event_id"])
    ).groupBy(F.col("event_type").alias("channel")).agg(F.count("*").alias("n"))


@query(
    "stream_enrichment",
    "SELECT s_name AS asset, count(*) AS n, round(sum(value), 4) AS total FROM events JOIN supplier ON user_id % 100 + 1 = s_suppkey GROUP BY s_name"
)
def stream_enrichment(spark, sf_dir):
    """Telemetry with asset metadata."""
    assets = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("asset"))
    rows = jobs.enriched(
        jobs.event_stream(spark, sf_dir).withColumn("s_suppkey", F.col("user_id") % 100 + 1), assets, "s_suppkey"
    )
    return jobs.drained(rows.select("asset", "value")).where("asset is not null").groupBy("asset").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


_ROLLUP = """SELECT event_type AS channel, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(max(abs(value)), 6) + 0.0 AS peak FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 24 HOURS FROM events) GROUP BY ALL"""


@query("stream_rollup_days", _ROLLUP)
def stream_rollup_days(spark, sf_dir):
    """Hours merged to days within one stream; days that are closed."""
    out = jobs.drained(jobs.rollup_features(jobs.event_stream(spark, sf_dir)))
    return out.select(
        F.col("event_type").alias("channel"),
        stamp(F.col("d.start")).alias("day"),
        "n",
        tidy(F.col("s") / F.col("n")).alias("mean"),
        tidy(F.col("peak")).alias("peak")
    )


@query(
    "stream_silent_devices",
    "SELECT user_id AS device_id, epoch_us(max(ts)) // 1000 AS last_ms FROM events GROUP BY user_id HAVING epoch_us(max(ts)) // 1000 + 43200000 <= (SELECT epoch_us(max(ts)) // 1000 FROM events)"
)
def stream_silent_devices(spark, sf_dir):
    """Devices reported silent by event-time timers."""
    return jobs.drained(jobs.silent(jobs.event_stream(spark, sf_dir), 12 * 3600 * 1000))


@query(
    "stream_scoring",
    "SELECT event_type AS channel, count(*) FILTER (WHERE value * 0.5 > 60) AS anomalies FROM events GROUP BY event_type"
)
def stream_scoring(spark, sf_dir):
    """An in-process score on the stream."""
    rows = jobs.event_stream(spark, sf_dir).select("event_type", "value")
    out = jobs.drained(
        jobs.scored(rows, lambda frame: frame["value"] * 0.5, "event_type string, value double, score double")
    )
    return out.groupBy(F.col("event_type").alias("channel")).agg(F.count_if(F.col("score") > 60).alias("anomalies"))


@query(
    "stream_replay_versions",
    "SELECT event_type AS channel, count(*) FILTER (WHERE value * 0.5 > 60) AS version_1, count(*) FILTER (WHERE value * 0.4 + 10 > 60) AS version_2 FROM events GROUP BY event_type",
)
def stream_replay_versions(spark, sf_dir):
    """History replayed with another model version: the same stream from its start under a checkpoint of its own."""
    def anomalies(name: str, score):
        rows = jobs.event_stream(spark, sf_dir).select("event_type", "value")
        out = jobs.drained(jobs.scored(rows, score, "event_type string, value double, score double"))
        return out.groupBy(F.col("event_type").alias("channel")).agg(F.count_if(F.col("score") > 60).alias(name))

    return anomalies("version_1", lambda f: f["value"] * 0.5).join(
        anomalies("version_2", lambda f: f["value"] * 0.4 + 10), "channel", "full"
    )


@query("stream_escalation", ESCALATION_SQL)
def stream_escalation(spark, sf_dir):
    """Escalation by timers in keyed state; a click acknowledges the alerts of its device."""
    kind = F.when(
        F.col("event_type") == "error", "alert"
    ).when(F.col("event_type") == "click", "ack").otherwise("other")
    return jobs.drained(
        jobs.escalated(jobs.event_stream(spark, sf_dir).withColumn("kind", kind), [m * MINUTE for m in (60, 240, 1440)])
    )


@query("stream_escalation_rules", ESCALATION_RULES_SQL)
def stream_escalation_rules(spark, sf_dir):
    """Escalation under the rules of each device's region, which its state begins with."""
    kind = F.when(
        F.col("event_type") == "error", "alert"
    ).when(F.col("event_type") == "click", "ack").otherwise("other")
    devices = events(spark, sf_dir).select(F.col("user_id").alias("device_id")).distinct()
    rules = devices.withColumn("site", (F.col("device_id") % 5).cast("long")).join(
        escalation_rules(spark, sf_dir), "site"
    )
    rows = jobs.event_stream(spark, sf_dir).withColumn("kind", kind)
    return jobs.drained(jobs.escalated(rows, [], rules=rules))


@query(
    "stream_lifecycle",
    """WITH o AS (SELECT *, CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS r FROM events), b AS (SELECT *, max(r) OVER (PARTITION BY user_id ORDER BY ts, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM o)
SELECT user_id AS alert_id, CASE max(r) WHEN 0 THEN 'OPEN' WHEN 1 THEN 'ACKNOWLEDGED' ELSE 'RESOLVED' END AS status, count(*) FILTER (WHERE r < p) AS illegal FROM b GROUP BY user_id""",
)
def stream_lifecycle(spark, sf_dir):
    """The state of each alert after the stream, and steps back that were ignored."""
    status = F.when(F.col("event_type") == "error", "OPEN").when(
        F.col("event_type") == "view", "ACKNOWLEDGED"
    ).otherwise("RESOLVED")
    rows = jobs.event_stream(spark, sf_dir).select(F.col("user_id").alias("alert_id"), "ts", status.alias("status"))
    return jobs.drained(jobs.lifecycle(rows), "update", ["alert_id"])


@query("stream_observed", "SELECT count(*) AS n, count(*) FILTER (WHERE value IS NULL OR value < 0) AS bad FROM events")
def stream_observed(spark, sf_dir):
    """Rows and bad rows of a stream as its listener wrote them down, batch by batch."""
    name, folder = f"seen_{uuid.uuid4().hex}", scratch(spark, "progress")
    put(f"{folder}/.made", b"")
    progress = jobs.Progress(folder)
    spark.streams.addListener(progress)
    try:
        jobs.drained(jobs.observed(jobs.event_stream(spark, sf_dir), name).select("event_id"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for _ in range(100):  # the listener hears of a batch a moment later
            seen = progress.table(spark).select(F.col("observed")[name].alias("o")).where("o is not null")
            if not seen.isEmpty():
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(progress)
    number = lambda key: F.sum(F.col("o")[key].cast("long")).alias(key)
    return seen.agg(number("n"), number("bad"))


@query("stream_transient_capture", SQL["transient_capture"])
def stream_transient_capture(spark, sf_dir):
    """What a device sent within six hours around each trigger, from ring buffers as the rows come."""
    rows = jobs.drained(
        keyed.captured(jobs.event_stream(spark, sf_dir), F.col("value") > 300, 6 * 3600 * 1_000_000), idle=False
    )
    return rows.groupBy("trigger_id").agg(
        F.count("*").alias("rows"), F.round(F.max(F.abs("value")), 6).alias("peak")
    )


@query(
    "stream_config_in_force",
    """WITH c AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'signup'), e AS (SELECT * FROM events WHERE event_type <> 'signup')
SELECT e.event_id, c.event_id AS version_id FROM e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.ts WHERE epoch_us(e.ts) // 1000 + 1 <= (SELECT epoch_us(max(ts)) // 1000 FROM events) - 86400000""",
)
def stream_config_in_force(spark, sf_dir):
    """Each event with the configuration that its device had at that time; events that the watermark has passed."""
    rows = jobs.event_stream(spark, sf_dir).withColumnRenamed("user_id", "device_id")
    return jobs.drained(
        keyed.in_force(rows.where("event_type <> 'signup'"), rows.where("event_type = 'signup'"))
    )


@query(
    "stream_segment_ingest",
    "SELECT event_type AS channel, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type"
)
def stream_segment_ingest(spark, sf_dir):
    """Telemetry through a log of append-only segments in which every tenth record was sent again."""
    log = scratch(spark, "log")
    rows = events(spark, sf_dir).select(
        F.col("user_id").alias("device_id"),
        F.col("event_id").alias("seq"),
        F.unix_micros("ts").alias("us"),
        "value",
        F.col("event_type").alias("channel")
    )
    sent = F.when(F.col("seq") % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    segments.append(rows.withColumn("sent", F.explode(sent)).drop("sent"), log, 8)
    once = jobs.deduplicated(segments.segment_stream(spark, log), ["device_id", "seq"])
    return jobs.drained(once.select("channel", "value")).groupBy("channel").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query("stream_alert_sink", SQL["alert_upsert"])
def stream_alert_sink(spark, sf_dir):
    """Alerts written through a sink with a ledger, each batch delivered twice; one row a device comes out."""
    rows = jobs.event_stream(spark, sf_dir).where("event_type = 'error'").select(
        F.col("user_id").alias("device_id"), "ts", F.col("event_id").alias("alert_id")
    )
    sink = LedgerSink(spark, scratch(spark, "alerts"))

    def keep(batch, batch_id: int) -> None:
        for _ in range(2):
            sink.commit(batch, batch_id)

    jobs.finished(rows.writeStream.option("checkpointLocation", scratch(spark, "alerts-state")).foreachBatch(keep))
    newest = sink.latest(rows.schema, ["device_id"], ["ts", "alert_id"])
    versions = sink.rows(rows.schema).groupBy("device_id").agg(F.count("*").alias("versions"))
    return newest.join(versions, "device_id").select("device_id", "versions", "alert_id")
