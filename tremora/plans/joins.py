"""Join queries: as-of, interval, hierarchy, anti, semi, outer, range, spine."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremora.operators import lags, orders, temporal
from tremora.plans.registry import events, query
from tremora.session import table

DAY_US = 24 * 3600 * 1_000_000


@query(
    "sensor_asof_align",
    """WITH v AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view'), c AS (SELECT user_id, ts, value FROM events WHERE event_type = 'click')
SELECT v.event_id, CASE WHEN epoch_us(v.ts) - epoch_us(c.ts) <= 86400000000 THEN c.value END AS temperature FROM v ASOF LEFT JOIN c ON v.user_id = c.user_id AND v.ts >= c.ts""",
)
def sensor_asof_align(spark, sf_dir):
    """Each vibration row with the latest temperature of its device within a day."""
    rows = events(spark, sf_dir).withColumn("us", F.unix_micros("ts"))
    left = rows.where("event_type = 'view'").select("user_id", "us", "event_id")
    right = rows.where("event_type = 'click'").select("user_id", "us", F.col("value").alias("temperature"))
    return temporal.asof(
        left, right, ["user_id"], "us", ["temperature"], F.lit(DAY_US)
    ).select("event_id", "temperature")


@query(
    "sensor_window_pivot",
    """SELECT user_id AS device_id, strftime(ts, '%Y-%m-%d') AS day, round(avg(value) FILTER (WHERE event_type = 'view'), 6) AS vib, round(avg(value) FILTER (WHERE event_type = 'click'), 6) AS temp,
  round(avg(value) FILTER (WHERE event_type = 'purchase'), 6) AS ae FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL""",
)
def sensor_window_pivot(spark, sf_dir):
    """Modalities side by side for each device and day."""
    rows = events(spark, sf_dir).where("event_type in ('view', 'click', 'purchase')").groupBy(
        F.col("user_id").alias("device_id"), F.date_format("ts", "yyyy-MM-dd").alias("day")
    )
    wide = rows.pivot("event_type", ["view", "click", "purchase"]).agg(F.round(F.avg("value"), 6))
    return wide.withColumnsRenamed({"view": "vib", "click": "temp", "purchase": "ae"})


@query(
    "electrical_vibration_interval",
    """SELECT a.event_id AS vibration_id, b.event_id AS electrical_id, round((a.value + b.value) / 2, 6) AS confidence FROM events a JOIN events b ON a.user_id = b.user_id
  AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000 WHERE a.event_type = 'view' AND b.event_type = 'error'""",
)
def electrical_vibration_interval(spark, sf_dir):
    """Anomalies of both kinds on one asset within an hour."""
    rows = events(spark, sf_dir)
    left = rows.where("event_type = 'view'").select(
        "user_id", F.unix_micros("ts").alias("a_us"), F.col("event_id").alias("vibration_id"), F.col("value").alias("a")
    )
    right = rows.where("event_type = 'error'").select(
        "user_id",
        F.unix_micros("ts").alias("b_us"),
        F.col("event_id").alias("electrical_id"),
        F.col("value").alias("b")
    )
    return temporal.interval(left, right, "user_id", "a_us", "b_us", 3_600_000_000).select(
        "vibration_id", "electrical_id", F.round((F.col("a") + F.col("b")) / 2, 6).alias("confidence")
    )


@query(
    "hierarchy_flatten",
    "SELECT r_name AS site, n_name AS area, s_suppkey AS asset_id, s_name AS asset FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
)
def hierarchy_flatten(spark, sf_dir):
    """Site, area and asset in one row."""
    area = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return table(spark, sf_dir, "supplier").join(area, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("r_name").alias("site"),
        F.col("n_name").alias("area"),
        F.col("s_suppkey").alias("asset_id"),
        F.col("s_name").alias("asset")
    )


_SPINE = "SELECT user_id, strftime(d, '%Y-%m-%d') AS day FROM (SELECT user_id, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS d FROM (SELECT DISTINCT user_id FROM events))"


def _spine(spark, sf_dir):
    """Every device on every day of the month: days are generated within each device's row."""
    days = F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date")))
    return events(spark, sf_dir).select("user_id").distinct().select("user_id", days.alias("d")).select(
        "user_id", F.date_format("d", "yyyy-MM-dd").alias("day")
    )


@query(
    "silent_devices",
    f"WITH s AS ({_SPINE}) SELECT s.user_id AS device_id, s.day FROM s ANTI JOIN (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events) e ON s.user_id = e.user_id AND s.day = e.day"
)
def silent_devices(spark, sf_dir):
    """Expected days without a row."""
    seen = events(spark, sf_dir).select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return _spine(spark, sf_dir).join(seen, ["user_id", "day"], "left_anti").withColumnRenamed("user_id", "device_id")


@query(
    "expected_minus_seen",
    f"WITH s AS ({_SPINE}) SELECT user_id AS device_id, day FROM s EXCEPT SELECT user_id, strftime(ts, '%Y-%m-%d') FROM events WHERE event_type = 'error'"
)
def expected_minus_seen(spark, sf_dir):
    seen = events(spark, sf_dir).where("event_type = 'error'").select(
        "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")
    )
    return _spine(spark, sf_dir).subtract(seen).withColumnRenamed("user_id", "device_id")


@query(
    "feedback_left_join",
    "SELECT lang, count(*) AS diagnoses, count(quality) AS reviewed, coalesce(CAST(sum(quality) AS BIGINT), 0) AS confirmed FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang"
)
def feedback_left_join(spark, sf_dir):
    """Diagnoses with or without feedback."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(
        table(spark, sf_dir, "labels"), "doc_id", "left"
    )
    return rows.groupBy("lang").agg(
        F.count("*").alias("diagnoses"),
        F.count("quality").alias("reviewed"),
        F.coalesce(F.sum("quality"), F.lit(0)).cast("long").alias("confirmed")
    )


@query(
    "auto_workorder_anti",
    "SELECT c_custkey AS asset_id, c_mktsegment AS class FROM customer ANTI JOIN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') o ON c_custkey = o_custkey"
)
def auto_workorder_anti(spark, sf_dir):
    """Assets without an open work order."""
    open_ = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(open_, "c_custkey", "left_anti").select(
        F.col("c_custkey").alias("asset_id"), F.col("c_mktsegment").alias("class")
    )


_CONFIRMED = "(SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"


@query(
    "confirmed_waveform_semi",
    f"SELECT o_orderkey AS waveform_id, o_custkey AS device_id FROM orders SEMI JOIN {_CONFIRMED} l ON o_orderkey = l_orderkey"
)
def confirmed_waveform_semi(spark, sf_dir):
    """Waveforms of confirmed faults."""
    confirmed = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("o_orderkey")
    )
    return table(spark, sf_dir, "orders").join(confirmed, "o_orderkey", "left_semi").select(
        F.col("o_orderkey").alias("waveform_id"), F.col("o_custkey").alias("device_id")
    )


@query(
    "expired_anti",
    f"SELECT o_orderkey AS waveform_id, o_custkey AS device_id FROM orders ANTI JOIN {_CONFIRMED} l ON o_orderkey = l_orderkey WHERE o_orderdate < TIMESTAMP '2001-08-01' - INTERVAL 90 DAYS"
)
def expired_anti(spark, sf_dir):
    """Waveforms past 90 days that no confirmed fault keeps."""
    confirmed = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("o_orderkey")
    )
    old = table(spark, sf_dir, "orders").where("o_orderdate < timestamp_ntz'2001-08-01' - interval 90 days")
    return old.join(confirmed, "o_orderkey", "left_anti").select(
        F.col("o_orderkey").alias("waveform_id"), F.col("o_custkey").alias("device_id")
    )


@query(
    "reconcile_full_outer",
    """WITH o AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT c_custkey AS k, c_acctbal FROM customer WHERE c_acctbal > 0)
SELECT coalesce(o.k, c.k) AS asset_id, CASE WHEN o.k IS NULL THEN 'only_cmms' WHEN c.k IS NULL THEN 'only_erp' ELSE 'both' END AS side, coalesce(n, 0) AS orders FROM o FULL OUTER JOIN c ON o.k = c.k""",
)
def reconcile_full_outer(spark, sf_dir):
    """Assets known to one system or both."""
    erp = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("a")).agg(F.count("*").alias("n"))
    cmms = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("b"))
    side = F.when(F.col("a").isNull(), "only_cmms").when(F.col("b").isNull(), "only_erp").otherwise("both")
    return erp.join(cmms, F.col("a") == F.col("b"), "full_outer").select(
        F.coalesce("a", "b").alias("asset_id"), side.alias("side"), F.coalesce("n", F.lit(0)).alias("orders")
    )


@query(
    "heatmap_pivot",
    """SELECT user_id AS asset_id, max(CASE WHEN value >= 250 THEN 4 WHEN value >= 150 THEN 3 WHEN value >= 80 THEN 2 ELSE 1 END) FILTER (WHERE ts < TIMESTAMP '2024-01-11') AS first_third,
  max(CASE WHEN value >= 250 THEN 4 WHEN value >= 150 THEN 3 WHEN value >= 80 THEN 2 ELSE 1 END) FILTER (WHERE ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-21') AS second_third,
  max(CASE WHEN value >= 250 THEN 4 WHEN value >= 150 THEN 3 WHEN value >= 80 THEN 2 ELSE 1 END) FILTER (WHERE ts >= TIMESTAMP '2024-01-21') AS last_third FROM events GROUP BY user_id""",
)
def heatmap_pivot(spark, sf_dir):
    """Worst severity stage by asset and third of the month."""
    stage = F.when(F.col("value") >= 250, 4).when(F.col("value") >= 150, 3).when(F.col("value") >= 80, 2).otherwise(1)
    day = F.date_format("ts", "yyyy-MM-dd")
    third = F.when(day < "2024-01-11", "first_third").when(day < "2024-01-21", "second_third").otherwise("last_third")
    return events(spark, sf_dir).withColumn("third", third).groupBy(F.col("user_id").alias("asset_id")).pivot(
        "third", ["first_third", "second_third", "last_third"]
    ).agg(F.max(stage))


@query(
    "calendar_spine_heatmap",
    f"""WITH s AS ({_SPINE}) SELECT s.user_id AS asset_id, s.day, coalesce(count(e.event_id), 0) AS n FROM s LEFT JOIN (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM events) e ON s.user_id = e.user_id AND s.day = e.day GROUP BY ALL""",
)
def calendar_spine_heatmap(spark, sf_dir):
    """Events of each asset on each day, zeros included."""
    counted = events(spark, sf_dir).groupBy(
        "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")
    ).agg(F.count("*").alias("n"))
    return _spine(spark, sf_dir).join(counted, ["user_id", "day"], "left").select(
        F.col("user_id").alias("asset_id"), "day", F.coalesce("n", F.lit(0)).alias("n")
    )


@query(
    "ab_compare",
    """SELECT a.label AS machine, count(*) AS n, round(avg(abs(a.s - b.s)), 6) AS mean_gap, count(*) FILTER (WHERE (a.s > 0) <> (b.s > 0)) AS disagree
FROM (SELECT vec_id, label, round(embedding[1], 6) AS s FROM embeddings) a JOIN (SELECT vec_id, round(embedding[2], 6) AS s FROM embeddings) b ON a.vec_id = b.vec_id GROUP BY a.label""",
)
def ab_compare(spark, sf_dir):
    """Scores of two model versions on the same waveforms."""
    rows = table(spark, sf_dir, "embeddings")
    a = rows.select("vec_id", F.col("label").alias("machine"), F.round(F.col("embedding")[0], 6).alias("a"))
    b = rows.select("vec_id", F.round(F.col("embedding")[1], 6).alias("b"))
    return a.join(b, "vec_id").groupBy("machine").agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 6).alias("mean_gap"),
        F.count_if((F.col("a") > 0) != (F.col("b") > 0)).alias("disagree")
    )


@query(
    "union_modalities",
    "SELECT source, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT 'vib' AS source, value FROM events WHERE event_type = 'view' UNION ALL SELECT 'elec', value FROM events WHERE event_type = 'error' UNION ALL SELECT 'wave', embedding[1] FROM embeddings) GROUP BY source"
)
def union_modalities(spark, sf_dir):
    """Rows of several modalities in one stream, missing columns filled."""
    e = events(spark, sf_dir)
    vib = e.where("event_type = 'view'").select(F.lit("vib").alias("source"), "value", "user_id")
    elec = e.where("event_type = 'error'").select(F.lit("elec").alias("source"), "value")
    wave = table(spark, sf_dir, "embeddings").select(
        F.lit("wave").alias("source"), F.col("embedding")[0].cast("double").alias("value")
    )
    return vib.unionByName(
        elec, allowMissingColumns=True
    ).unionByName(wave, allowMissingColumns=True).groupBy("source").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query(
    "modality_correlation",
    """WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS h, avg(value) FILTER (WHERE event_type = 'view') AS a, avg(value) FILTER (WHERE event_type = 'error') AS b FROM events GROUP BY 1)
SELECT count(*) AS windows, round(corr(a, b), 6) AS r FROM w WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def modality_correlation(spark, sf_dir):
    """Correlation of two modalities over hourly windows."""
    hours = events(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").alias("h")).agg(
        F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("a"),
        F.avg(F.when(F.col("event_type") == "error", F.col("value"))).alias("b")
    )
    return hours.where("a is not null and b is not null").agg(
        F.count("*").alias("windows"), F.round(F.corr("a", "b"), 6).alias("r")
    )


@query(
    "iso_zone_range",
    """SELECT zone, count(*) AS n FROM events JOIN (VALUES ('A', 0.0, 30.0), ('B', 30.0, 100.0), ('C', 100.0, 200.0), ('D', 200.0, 1000.0)) z(zone, low, high) ON value >= low AND value < high GROUP BY zone""",
)
def iso_zone_range(spark, sf_dir):
    """Velocity zones from a table of limits, joined by range."""
    zones = spark.createDataFrame(
        [("A", 0.0, 30.0), ("B", 30.0, 100.0), ("C", 100.0, 200.0), ("D", 200.0, 1000.0)],
        "zone string, low double, high double"
    )
    return temporal.range_to_bin(
        events(spark, sf_dir), zones, "value", "low", "high", 10.0
    ).groupBy("zone").agg(F.count("*").alias("n"))


@query(
    "alert_assignment",
    """SELECT n_name AS technician, count(*) AS alerts FROM events JOIN supplier ON user_id % 100 + 1 = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE event_type = 'error' GROUP BY n_name""",
)
def alert_assignment(spark, sf_dir):
    """Alerts by the technician of the asset's area."""
    alerts = events(spark, sf_dir).where("event_type = 'error'").select((F.col("user_id") % 100 + 1).alias("s_suppkey"))
    area = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    return alerts.join(area, "s_suppkey").groupBy(F.col("n_name").alias("technician")).agg(F.count("*").alias("alerts"))


@query(
    "purchase_order_rows",
    """SELECT p_partkey AS part_no, s_name AS supplier, 20 - p_size AS quantity FROM part JOIN supplier ON p_partkey % (SELECT count(*) FROM supplier) + 1 = s_suppkey WHERE p_size <= 10""",
)
def purchase_order_rows(spark, sf_dir):
    """Order rows for parts at or below the reorder point."""
    suppliers = table(spark, sf_dir, "supplier")
    total = F.broadcast(suppliers.agg(F.count("*").alias("n")).withColumn("one", F.lit(1)))  # one row
    low = table(spark, sf_dir, "part").where("p_size <= 10").withColumn("one", F.lit(1)).join(total, "one")
    low = low.withColumn("s_suppkey", F.col("p_partkey") % F.col("n") + 1)
    return low.join(suppliers, "s_suppkey").select(
        F.col("p_partkey").alias("part_no"),
        F.col("s_name").alias("supplier"),
        (F.lit(20) - F.col("p_size")).alias("quantity")
    )


_TACHO = """t AS (SELECT user_id, us, row_number() OVER w - 1 AS turn, lead(us) OVER w AS until FROM (SELECT DISTINCT user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'signup') WINDOW w AS (PARTITION BY user_id ORDER BY us)),
s AS (SELECT e.user_id, e.event_id, e.us, e.value, t.turn + (e.us - t.us) / (t.until - t.us) AS p FROM (SELECT *, epoch_us(ts) AS us FROM events WHERE event_type <> 'signup') e ASOF JOIN t ON e.user_id = t.user_id AND e.us >= t.us WHERE t.until IS NOT NULL)"""
STEPS, STRETCH = 8, 4


def _phased(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", "event_type", "value", F.unix_micros("ts").alias("us"))
    return orders.shaft_phase(
        rows.where("event_type <> 'signup'").drop("event_type"),
        rows.where("event_type = 'signup'"),
        ["user_id"],
        "us",
        7 * DAY_US
    )


@query(
    "shaft_phase",
    f"WITH {_TACHO} SELECT event_id, CAST(floor(round(p, 9)) AS BIGINT) AS turn, round(p - floor(round(p, 9)), 6) + 0.0 AS phase FROM s"
)
def shaft_phase(spark, sf_dir):
    """The turn and the phase of each sample, from the tacho pulses of its device."""
    turn = F.floor(F.round("position", 9))
    return _phased(spark, sf_dir).select(
        "event_id", turn.alias("turn"), (F.round(F.col("position") - turn, 6) + 0.0).alias("phase")
    )


@query(
    "order_tracking",
    f"""WITH {_TACHO}, l AS (SELECT *, lag(p) OVER w AS p0, lag(value) OVER w AS v0 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY p, us, event_id)),
g AS (SELECT *, unnest(range(CAST(floor(p0 * {STEPS}) AS BIGINT) + 1, CAST(floor(p * {STEPS}) AS BIGINT) + 1)) AS j FROM l WHERE p0 IS NOT NULL),
b AS (SELECT user_id, j // {STEPS * STRETCH} AS block, list(v0 + (value - v0) * (j / {STEPS} - p0) / (p - p0) ORDER BY j) AS x FROM g GROUP BY ALL HAVING count(*) = {STEPS * STRETCH}),
k AS (SELECT *, unnest(range(1, {STEPS // 2})) AS k FROM b)
SELECT user_id AS device_id, block, k AS "order", round(2 * sqrt(pow(list_sum(list_transform(x, lambda v, i: v * cos(2 * pi() * k * {STRETCH} * (i - 1) / len(x)))), 2) + pow(list_sum(list_transform(x, lambda v, i: v * sin(2 * pi() * k * {STRETCH} * (i - 1) / len(x)))), 2)) / len(x), 4) + 0.0 AS amplitude FROM k""",
)
def order_tracking(spark, sf_dir):
    """Amplitudes of the orders of each device over stretches of four turns, sampled by shaft angle."""
    even = orders.even_steps(_phased(spark, sf_dir), ["user_id"], ["us", "event_id"], "value", STEPS)
    spectra = orders.order_spectra(even, ["user_id"], "value", STEPS, STRETCH)
    numbers = F.explode(F.sequence(F.lit(1), F.lit(STEPS // 2 - 1))).alias("order")
    rows = spectra.select(F.col("user_id").alias("device_id"), "block", "spectrum", numbers)
    return rows.select(
        "device_id",
        "block",
        F.col("order").cast("long").alias("order"),
        (F.round(F.element_at("spectrum", F.col("order") * STRETCH + 1), 4) + 0.0).alias("amplitude")
    )


LAGS, PERIOD = 24, 2160
_PAIRS = (("click", "view"), ("error", "view"), ("click", "error"))


@query(
    "lagged_correlation",
    f"""WITH h AS (SELECT user_id, event_type, epoch_us(ts) // 3600000000 AS h, avg(value) AS v FROM events GROUP BY ALL), c AS (SELECT user_id, event_type, h // {PERIOD} AS period, h, v - avg(v) OVER (PARTITION BY user_id, event_type, h // {PERIOD}) AS x FROM h),
n AS (SELECT user_id, period, event_type, sum(x * x) AS q FROM c GROUP BY ALL), p AS (SELECT * FROM (VALUES {", ".join(map(str, _PAIRS))}) t(one, other)), l AS (SELECT CAST(unnest(range(-{LAGS}, {LAGS + 1})) AS INTEGER) AS lag),
k AS (SELECT a.user_id, a.period, p.one, p.other, lag, a.q AS qa, b.q AS qb FROM n a JOIN n b ON a.user_id = b.user_id AND a.period = b.period JOIN p ON p.one = a.event_type AND p.other = b.event_type, l WHERE a.q > 1e-20 AND b.q > 1e-20),
s AS (SELECT a.user_id, a.period, a.event_type AS one, b.event_type AS other, CAST(b.h - a.h AS INTEGER) AS lag, sum(a.x * b.x) AS s FROM c a JOIN c b ON a.user_id = b.user_id AND a.period = b.period AND b.h BETWEEN a.h - {LAGS} AND a.h + {LAGS} JOIN p ON p.one = a.event_type AND p.other = b.event_type GROUP BY ALL),
r AS (SELECT k.*, round(coalesce(s, 0) / sqrt(qa * qb), 9) AS r FROM k LEFT JOIN s USING (user_id, period, one, other, lag))
SELECT user_id AS asset_id, period, one, other, lag, round(r, 6) + 0.0 AS r FROM r QUALIFY row_number() OVER (PARTITION BY user_id, period, one, other ORDER BY abs(r) DESC, abs(lag), lag) = 1""",
)
def lagged_correlation(spark, sf_dir):
    """The lag in hours at which two modalities of an asset go together best, and how well; quarters of a year apart."""
    hour = F.floor(F.unix_micros("ts") / 3_600_000_000)
    kinds = sorted({k for pair in _PAIRS for k in pair})
    hours = events(spark, sf_dir).where(F.col("event_type").isin(kinds)).groupBy(
        F.col("user_id").alias("asset_id"), "event_type", hour.alias("h")
    ).agg(F.avg("value").alias("v"))
    point = F.struct("h", "v")
    # a quarter has 2,160 hours at most, whatever was sent in them
    series = hours.groupBy("asset_id", F.floor(F.col("h") / PERIOD).alias("period")).agg(
        *(F.collect_list(F.when(F.col("event_type") == k, point)).alias(k) for k in kinds)
    )
    best = lags.best_lag(LAGS)
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("one"), F.lit(b).alias("other"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in _PAIRS)))
    found = series.select("asset_id", "period", pairs.alias("p")).select(
        "asset_id", "period", "p.one", "p.other", best("p.a", "p.b").alias("best")
    )
    return found.where("best is not null").select(
        "asset_id", "period", "one", "other", "best.lag", (F.round("best.r", 6) + 0.0).alias("r")
    )
