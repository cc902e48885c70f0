"""Windowed features of telemetry, roll-ups, metric reads and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremora.functions.features import features, finished, merged, moments, tidy
from tremora.operators.ranks import quantiles
from tremora.plans.registry import events, query, stamp
from tremora.session import table

_FEATURES = """count(value) AS n, round(sqrt(avg(value * value)), 6) + 0.0 AS rms, round(max(abs(value)), 6) + 0.0 AS peak, round(avg(value), 6) + 0.0 AS mean,
  round(stddev_samp(value), 6) + 0.0 AS std, round(kurtosis_pop(value), 6) + 0.0 AS kurtosis, round(max(abs(value)) / nullif(sqrt(avg(value * value)), 0), 6) + 0.0 AS crest"""
_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query(
    "window_features_sliding",
    f"""WITH e AS (SELECT event_type, value, time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(CAST(k AS INTEGER)) AS w FROM events, range(5) r(k))
SELECT event_type AS channel, {_STAMP.format("w")} AS window_start, {_FEATURES} FROM e GROUP BY event_type, w""",
)
def window_features_sliding(spark, sf_dir):
    """RMS, peak, mean, deviation, kurtosis and crest factor in 5-minute windows every minute."""
    w = F.window("ts", "5 minutes", "1 minute")
    return events(spark, sf_dir).groupBy(
        F.col("event_type").alias("channel"), w.alias("w")
    ).agg(*features(F.col("value"))).withColumn("window_start", stamp(F.col("w.start"))).drop("w")


def _tumbling(name: str, spark_width: str, duck_width: str) -> None:
    @query(
        f"window_features_tumbling_{name}",
        f"SELECT event_type AS channel, {_STAMP.format(f"time_bucket(INTERVAL {duck_width}, ts, TIMESTAMP '1970-01-01')")} AS window_start, {_FEATURES} FROM events GROUP BY event_type, time_bucket(INTERVAL {duck_width}, ts, TIMESTAMP '1970-01-01')",
    )
    def run(spark, sf_dir):
        return events(spark, sf_dir).groupBy(
            F.col("event_type").alias("channel"), F.window("ts", spark_width).alias("w")
        ).agg(*features(F.col("value"))).withColumn("window_start", stamp(F.col("w.start"))).drop("w")


for _args in (
    ("1m", "1 minute", "1 MINUTE"),
    ("5m", "5 minutes", "5 MINUTES"),
    ("1h", "1 hour", "1 HOUR"),
    ("24h", "24 hours", "24 HOURS")
):
    _tumbling(*_args)

CENTRE = 100.0
_NUDGED = _FEATURES.replace(
    "round(kurtosis_pop(value), 6)", "round(kurtosis_pop(value) + 1e-7, 4)"
).replace(", 6)", " + 1e-9, 6)")


@query(
    "moment_rollup_1h_to_24h",
    f"""SELECT event_type AS channel, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, {_NUDGED} FROM events GROUP BY event_type, date_trunc('day', ts)""",
)
def moment_rollup_1h_to_24h(spark, sf_dir):
    """Daily features from hourly moments: averages of averages would be wrong."""
    hourly = events(spark, sf_dir).groupBy(
        "event_type", F.date_trunc("hour", "ts").alias("hour")
    ).agg(*moments(F.col("value"), CENTRE))
    daily = hourly.groupBy(
        F.col("event_type").alias("channel"), F.date_trunc("day", "hour").alias("day")
    ).agg(*merged())
    return daily.select("channel", stamp(F.col("day")).alias("day"), *finished(CENTRE))


@query(
    "skewness_channel_daily",
    """SELECT event_type AS channel, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, count(*) AS n,
  CASE WHEN count(*) > 2 THEN round(skewness(value) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)), 6) + 0.0 END AS skewness FROM events GROUP BY ALL""",
)
def skewness_channel_daily(spark, sf_dir):
    day = F.date_trunc("day", "ts")
    n = F.count("*")
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("channel"), stamp(day).alias("day")).agg(
        n.alias("n"), F.when(n > 2, tidy(F.skewness("value"))).alias("skewness")
    )


@query(
    "metric_range_downsample",
    """SELECT user_id AS device_id, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS bucket, count(*) AS n, round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value
FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND event_type = 'view' GROUP BY ALL""",
)
def metric_range_downsample(spark, sf_dir):
    """A metric between two times at one-hour resolution."""
    rows = table(spark, sf_dir, "events").where(
        "ts >= timestamp_ntz'2024-01-05' and ts < timestamp_ntz'2024-01-20' and event_type = 'view'"
    )
    return rows.groupBy(F.col("user_id").alias("device_id"), stamp(F.date_trunc("hour", "ts")).alias("bucket")).agg(
        F.count("*").alias("n"),
        F.round(F.avg("value"), 6).alias("avg_value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value")
    )


@query(
    "p99_latency",
    "SELECT event_type AS endpoint, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type"
)
def p99_latency(spark, sf_dir):
    """Exact percentiles for each endpoint: sketches of its days, merged, bound what is ranked."""
    rows = events(spark, sf_dir).select(F.col("event_type").alias("endpoint"), "value", "ts")
    found = quantiles(rows, ["endpoint"], "value", {"p50": 0.5, "p99": 0.99}, F.to_date("ts"))
    counts = rows.groupBy("endpoint").agg(F.count("*").alias("n"))
    return counts.join(found, "endpoint", "left").select(
        "endpoint", "n", F.round("p50", 6).alias("p50"), F.round("p99", 6).alias("p99")
    )


@query(
    "payload_json_extract",
    "SELECT CAST(props ->> '$.k' AS BIGINT) AS k, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY 1"
)
def payload_json_extract(spark, sf_dir):
    """Payload fields by an explicit schema; malformed payloads give nulls."""
    parsed = events(spark, sf_dir).withColumn("p", F.from_json("props", "k long", {"mode": "PERMISSIVE"}))
    return parsed.groupBy(F.col("p.k").alias("k")).agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value")
    )


@query(
    "topic_parse",
    "SELECT CAST(user_id AS VARCHAR) AS device_id, event_type AS kind, count(*) AS n FROM events GROUP BY ALL"
)
def topic_parse(spark, sf_dir):
    """Device and kind out of sensors/{device}/{kind}."""
    topic = F.format_string("sensors/%d/%s", F.col("user_id"), F.col("event_type"))
    pattern = r"^sensors/([^/]+)/([^/]+)$"
    return events(spark, sf_dir).select(topic.alias("t")).select(
        F.regexp_extract("t", pattern, 1).alias("device_id"), F.regexp_extract("t", pattern, 2).alias("kind")
    ).groupBy("device_id", "kind").agg(F.count("*").alias("n"))


@query(
    "range_validation",
    "SELECT event_type AS channel, count(*) FILTER (WHERE value BETWEEN 1 AND 150) AS valid, count(*) FILTER (WHERE NOT value BETWEEN 1 AND 150) AS quarantined FROM events GROUP BY event_type"
)
def range_validation(spark, sf_dir):
    ok = F.col("value").between(1, 150)
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("channel")).agg(
        F.count_if(ok).alias("valid"), F.count_if(~ok).alias("quarantined")
    )


@query(
    "pipeline_metrics",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS throughput, round(max(epoch(TIMESTAMP '2024-02-01' - ts)), 3) AS max_lag_s,
  round(count(*) FILTER (WHERE event_type = 'error') * 1.0 / count(*), 6) AS error_rate, count(DISTINCT user_id) AS active_devices FROM events GROUP BY 1""",
)
def pipeline_metrics(spark, sf_dir):
    """Throughput, lag, error rate and active devices by hour, at a stated time."""
    lag = F.unix_micros(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros("ts")
    return events(spark, sf_dir).groupBy(stamp(F.date_trunc("hour", "ts")).alias("hour")).agg(
        F.count("*").alias("throughput"),
        F.round(F.max(lag) / 1e6, 3).alias("max_lag_s"),
        F.round(F.count_if(F.col("event_type") == "error") / F.count("*"), 6).alias("error_rate"),
        F.countDistinct("user_id").alias("active_devices")
    )


@query(
    "late_backfill",
    """WITH e AS (SELECT *, ts + to_hours(CAST(event_id % 30 AS INTEGER)) AS arrival FROM events)
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) FILTER (WHERE epoch(arrival - ts) <= 24 * 3600) AS on_time, count(*) FILTER (WHERE epoch(arrival - ts) > 24 * 3600) AS backfilled FROM e GROUP BY 1""",
)
def late_backfill(spark, sf_dir):
    """Rows within the 24 hours of lateness and rows for the backfill, by event day."""
    hours = F.col("event_id") % 30
    return events(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count_if(hours <= 24).alias("on_time"), F.count_if(hours > 24).alias("backfilled")
    )
