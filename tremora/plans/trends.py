"""Analytic-window queries: trends, baselines, ranks, latest values, histories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tremora.functions.features import significant, significant_sql, tidy
from tremora.operators.ranks import quantile
from tremora.operators.temporal import trailing
from tremora.plans.registry import events, query, stamp
from tremora.session import table


def _by_device():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query(
    "anomaly_trend_slope",
    """SELECT event_id, round(regr_slope(value, n) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) + 0.0 AS slope
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS n FROM events)""",
)
def anomaly_trend_slope(spark, sf_dir):
    """Slope of the last ten scores of each device."""
    rows = events(spark, sf_dir).withColumn("x", F.row_number().over(_by_device()).cast("double"))
    w = Window.partitionBy("user_id").orderBy("x").rowsBetween(-9, 0)
    return rows.select("event_id", tidy(F.regr_slope("value", "x").over(w)).alias("slope"))


@query(
    "adaptive_baseline",
    f"""WITH t AS (SELECT event_id, value, CASE WHEN count(*) OVER w > 1 THEN avg(value) OVER w + 3 * stddev_samp(value) OVER w END AS t FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING))
SELECT event_id, {significant_sql("t")} AS threshold, coalesce(value > t, false) AS anomaly FROM t""",
)
def adaptive_baseline(spark, sf_dir):
    """Mean and three deviations of the seven days before; the cost doesn't grow with the rows of a week."""
    rows = events(spark, sf_dir).withColumn("us", F.unix_micros("ts"))
    week = trailing(
        rows, ["user_id"], "event_id", "us", "value", {"w": 7 * 24 * 3600 * 1_000_000}, current=False, carry=["value"]
    )
    limit = F.when(F.col("n_w") > 1, F.col("mean_w") + 3 * F.sqrt(F.col("m2_w") / (F.col("n_w") - 1)))
    return week.select(
        "event_id",
        significant(limit).alias("threshold"),
        F.coalesce(F.col("value") > limit, F.lit(False)).alias("anomaly")
    )


@query(
    "percentile_rank_baseline",
    "SELECT event_id, round(percent_rank() OVER (PARTITION BY user_id ORDER BY value), 6) AS rank FROM events"
)
def percentile_rank_baseline(spark, sf_dir):
    return events(spark, sf_dir).select(
        "event_id", F.round(F.percent_rank().over(Window.partitionBy("user_id").orderBy("value")), 6).alias("rank")
    )


@query(
    "latest_value",
    "SELECT user_id AS device_id, event_type AS metric, arg_max(value, struct_pack(a := ts, b := event_id)) AS value FROM events GROUP BY ALL"
)
def latest_value(spark, sf_dir):
    """Latest value of each metric: an aggregate, so only one row per key and task is shuffled."""
    return events(spark, sf_dir).groupBy(
        F.col("user_id").alias("device_id"), F.col("event_type").alias("metric")
    ).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query(
    "top5_features",
    """SELECT user_id AS device_id, event_id, CAST(place AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(value) DESC, event_id) AS place FROM events) WHERE place <= 5""",
)
def top5_features(spark, sf_dir):
    """The five largest contributions of each device."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.abs("value").desc(), "event_id"))
    return events(spark, sf_dir).withColumn("place", place).where("place <= 5").select(
        F.col("user_id").alias("device_id"), "event_id", F.col("place").cast("long").alias("place")
    )


@query(
    "health_trend_30_90_365",
    """SELECT o_orderkey AS id, round(avg(o_totalprice) OVER a + 1e-7, 4) AS d30, round(avg(o_totalprice) OVER b + 1e-7, 4) AS d90, round(avg(o_totalprice) OVER c + 1e-7, 4) AS d365 FROM orders
WINDOW a AS (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW), b AS (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW),
 c AS (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND CURRENT ROW)""",
)
def health_trend_30_90_365(spark, sf_dir):
    """Means of the last 30, 90 and 365 days of each asset."""
    day, spans = 24 * 3600, (30, 90, 365)
    rows = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_totalprice", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("s")
    )
    means = trailing(
        rows, ["o_custkey"], "o_orderkey", "s", "o_totalprice", {f"d{d}": d * day for d in spans}, current=True
    )
    return means.select(
        F.col("o_orderkey").alias("id"), *(F.round(F.col(f"mean_d{d}") + 1e-7, 4).alias(f"d{d}") for d in spans)
    )


@query(
    "stage_changes",
    """WITH s AS (SELECT *, CASE WHEN value >= 250 THEN 4 WHEN value >= 150 THEN 3 WHEN value >= 80 THEN 2 ELSE 1 END AS stage FROM events),
l AS (SELECT *, lag(stage) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM s) SELECT event_id, before, stage FROM l WHERE before IS NOT NULL AND before <> stage""",
)
def stage_changes(spark, sf_dir):
    """Rows where the severity stage of a device changes."""
    stage = F.when(F.col("value") >= 250, 4).when(F.col("value") >= 150, 3).when(F.col("value") >= 80, 2).otherwise(1)
    rows = events(spark, sf_dir).withColumn("stage", stage).withColumn("before", F.lag("stage").over(_by_device()))
    return rows.where("before <> stage").select("event_id", "before", "stage")


@query(
    "outlier_mad",
    """WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS med FROM events GROUP BY event_type), d AS (SELECT e.event_type, med, quantile_cont(abs(value - med), 0.5) AS mad FROM events e JOIN m ON e.event_type = m.event_type GROUP BY ALL)
SELECT event_id, round((value - med) / (1.4826 * mad), 6) AS z FROM events e JOIN d ON e.event_type = d.event_type WHERE abs(value - med) > 3.5 * 1.4826 * mad""",
)
def outlier_mad(spark, sf_dir):
    """Rows whose robust z is over 3.5."""
    rows = events(spark, sf_dir)
    middle = quantile(rows, ["event_type"], "value", 0.5, "med")
    away = rows.join(middle, "event_type").withColumn("away", F.abs(F.col("value") - F.col("med")))
    spread = quantile(away, ["event_type", "med"], "away", 0.5, "mad")
    z = (F.col("value") - F.col("med")) / (1.4826 * F.col("mad"))
    return rows.join(spread, "event_type").where(
        F.abs(F.col("value") - F.col("med")) > 3.5 * 1.4826 * F.col("mad")
    ).select("event_id", F.round(z, 6).alias("z"))


@query(
    "pm_due_runtime",
    """WITH c AS (SELECT l_suppkey, l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS hours, l_quantity FROM lineitem)
SELECT l_suppkey AS asset_id, count(*) FILTER (WHERE floor(hours / 500) > floor((hours - l_quantity) / 500)) AS services, max(hours) AS runtime_hours FROM c GROUP BY l_suppkey""",
)
def pm_due_runtime(spark, sf_dir):
    """Services that fell due every 500 hours of runtime."""
    w = Window.partitionBy("l_suppkey").orderBy(
        "l_shipdate", "l_orderkey", "l_linenumber"
    ).rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, sf_dir, "lineitem").withColumn("hours", F.sum("l_quantity").over(w))
    due = F.floor(F.col("hours") / 500) > F.floor((F.col("hours") - F.col("l_quantity")) / 500)
    return rows.groupBy(F.col("l_suppkey").alias("asset_id")).agg(
        F.count_if(due).alias("services"), F.max("hours").alias("runtime_hours")
    )


@query(
    "calibration_drift",
    """SELECT user_id AS device_id, round(avg(value) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') - avg(value) FILTER (WHERE ts < TIMESTAMP '2024-01-16'), 6) + 0.0 AS drift FROM events GROUP BY user_id""",
)
def calibration_drift(spark, sf_dir):
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
    return events(spark, sf_dir).groupBy(F.col("user_id").alias("device_id")).agg(
        tidy(F.avg(F.when(late, F.col("value"))) - F.avg(F.when(~late, F.col("value")))).alias("drift")
    )


@query(
    "power_factor_decline",
    """SELECT user_id AS asset_id, round(regr_slope(value, epoch(ts) / 86400), 6) + 0.0 AS slope, round(regr_slope(value, epoch(ts) / 86400), 6) < 0 AS declining FROM events WHERE event_type = 'purchase' GROUP BY user_id HAVING count(*) > 2""",
)
def power_factor_decline(spark, sf_dir):
    """Trend of the power factor per day."""
    day = F.unix_micros("ts") / 86_400e6
    slope = tidy(F.regr_slope(F.col("value"), day))
    return events(spark, sf_dir).where("event_type = 'purchase'").groupBy(F.col("user_id").alias("asset_id")).agg(
        slope.alias("slope"), F.count("*").alias("n")
    ).where("n > 2").select(
        "asset_id", "slope", (F.col("slope") < 0).alias("declining")
    )


@query(
    "spc_control_limits",
    """SELECT event_type AS channel, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, round(avg(value), 6) AS mean, abs(avg(value) - any_value(m)) > 3 * any_value(s) / sqrt(count(*)) AS out_of_control
FROM (SELECT *, avg(value) OVER (PARTITION BY event_type) AS m, stddev_samp(value) OVER (PARTITION BY event_type) AS s FROM events) GROUP BY ALL""",
)
def spc_control_limits(spark, sf_dir):
    """Daily means outside three standard errors of the channel."""
    rows = events(spark, sf_dir)
    whole = rows.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    days = rows.groupBy(
        "event_type", F.date_trunc("day", "ts").alias("d")
    ).agg(F.avg("value").alias("x"), F.count("*").alias("n"))
    out = F.abs(F.col("x") - F.col("m")) > 3 * F.col("s") / F.sqrt("n")
    return days.join(whole, "event_type").select(
        F.col("event_type").alias("channel"),
        stamp(F.col("d")).alias("day"),
        F.round("x", 6).alias("mean"),
        out.alias("out_of_control")
    )
