"""Reliability, cost, usage and retention queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tremora.functions.features import tidy
from tremora.plans.registry import events, query
from tremora.session import table

AS_OF = "2001-12-01"


@query(
    "mtbf_mttr_rollup",
    """WITH d AS (SELECT l_orderkey, max(l_shipdate) AS done FROM lineitem GROUP BY l_orderkey),
g AS (SELECT c_mktsegment, o_custkey, epoch(done - o_orderdate) / 86400 AS repair, epoch(o_orderdate - lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) / 86400 AS gap FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN d ON l_orderkey = o_orderkey)
SELECT c_mktsegment AS class, o_custkey AS asset_id, CAST(grouping(c_mktsegment) * 2 + grouping(o_custkey) AS BIGINT) AS level, round(avg(gap) + 1e-7, 4) AS mtbf_days, round(avg(repair) + 1e-7, 4) AS mttr_days FROM g GROUP BY ROLLUP (c_mktsegment, o_custkey)""",
)
def mtbf_mttr_rollup(spark, sf_dir):
    """Mean days between failures, and from opening to the last part shipped, for assets, classes and all."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    us = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    rows = table(spark, sf_dir, "orders").withColumn("gap", (us - F.lag(us).over(w)) / 86_400e6)
    done = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.max(F.unix_micros(F.col("l_shipdate").cast("timestamp"))).alias("done")
    )
    rows = rows.join(done, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn(
        "repair", (F.col("done") - us) / 86_400e6
    )
    joined = rows.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.rollup(F.col("c_mktsegment").alias("class"), F.col("o_custkey").alias("asset_id")).agg(
        F.grouping_id().alias("level"),
        F.round(F.avg("gap") + 1e-7, 4).alias("mtbf_days"),
        F.round(F.avg("repair") + 1e-7, 4).alias("mttr_days")
    )


@query(
    "oee",
    """SELECT l_suppkey AS asset_id, round(avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS availability, round(sum(l_quantity) / (50.0 * count(*)), 6) AS performance, round(avg(CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE 1.0 END), 6) AS quality,
  round(avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END) * sum(l_quantity) / (50.0 * count(*)) * avg(CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE 1.0 END), 6) AS oee FROM lineitem GROUP BY l_suppkey""",
)
def oee(spark, sf_dir):
    """Availability times performance times quality."""
    a = F.avg(F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0))
    p = F.sum("l_quantity") / (50.0 * F.count("*"))
    q = F.avg(F.when(F.col("l_returnflag") == "R", 0.0).otherwise(1.0))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("asset_id")).agg(
        F.round(a, 6).alias("availability"),
        F.round(p, 6).alias("performance"),
        F.round(q, 6).alias("quality"),
        F.round(a * p * q, 6).alias("oee")
    )


@query(
    "maintenance_cost",
    "SELECT l_suppkey AS asset_id, round(sum(l_quantity * 20), 2) AS labor, round(sum(l_extendedprice * (1 - l_discount)), 2) AS parts, round(sum(l_quantity * 20) + sum(l_extendedprice * (1 - l_discount)), 2) AS total FROM lineitem GROUP BY l_suppkey",
)
def maintenance_cost(spark, sf_dir):
    labor, parts = F.sum(F.col("l_quantity") * 20), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("asset_id")).agg(
        F.round(labor, 2).alias("labor"), F.round(parts, 2).alias("parts"), F.round(labor + parts, 2).alias("total")
    )


@query(
    "predicted_savings",
    "SELECT o_orderpriority AS class, round(sum(o_totalprice * 1.4 - o_totalprice), 2) AS savings FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority",
)
def predicted_savings(spark, sf_dir):
    """Avoided cost, by a configured multiple, minus actual cost."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(
        F.col("o_orderpriority").alias("class")
    ).agg(
        F.round(F.sum(F.col("o_totalprice") * 1.4 - F.col("o_totalprice")), 2).alias("savings")
    )


@query(
    "usage_metering",
    "SELECT user_id % 10 AS tenant_id, count(DISTINCT (user_id, CAST(ts AS DATE))) AS sensor_days, count(*) AS api_calls FROM events GROUP BY 1"
)
def usage_metering(spark, sf_dir):
    """Sensor days and calls of each tenant."""
    return events(spark, sf_dir).groupBy((F.col("user_id") % 10).alias("tenant_id")).agg(
        F.countDistinct("user_id", F.to_date("ts")).alias("sensor_days"), F.count("*").alias("api_calls")
    )


@query(
    "tenant_quota",
    "SELECT user_id % 10 AS tenant_id, count(DISTINCT user_id) AS devices, count(DISTINCT user_id) > 14 AS over_quota FROM events GROUP BY 1"
)
def tenant_quota(spark, sf_dir):
    devices = F.countDistinct("user_id")
    return events(spark, sf_dir).groupBy((F.col("user_id") % 10).alias("tenant_id")).agg(
        devices.alias("devices"), (devices > 14).alias("over_quota")
    )


@query(
    "retention_tiers",
    f"""SELECT CASE WHEN d <= 30 THEN 'hot' WHEN d <= 365 THEN 'cold' WHEN d <= 7 * 365 THEN 'archive' ELSE 'expired' END AS tier, count(*) AS n, min(d) AS youngest, max(d) AS oldest
FROM (SELECT date_diff('day', CAST(l_shipdate AS DATE), DATE '{AS_OF}') AS d FROM lineitem) GROUP BY 1""",
)
def retention_tiers(spark, sf_dir):
    """Age of every row at a stated date against the tiers of 30 days, a year and seven years."""
    age = F.date_diff(F.lit(AS_OF).cast("date"), F.to_date("l_shipdate")).cast("long")
    tier = F.when(F.col("d") <= 30, "hot").when(F.col("d") <= 365, "cold").when(
        F.col("d") <= 7 * 365, "archive"
    ).otherwise("expired")
    return table(spark, sf_dir, "lineitem").select(age.alias("d")).groupBy(tier.alias("tier")).agg(
        F.count("*").alias("n"), F.min("d").alias("youngest"), F.max("d").alias("oldest")
    )


@query(
    "low_stock",
    "SELECT p_partkey AS part_no, p_size AS on_hand, 10 + p_partkey % 5 AS reorder_point FROM part WHERE p_size <= 10 + p_partkey % 5"
)
def low_stock(spark, sf_dir):
    """Parts at or below their reorder point."""
    reorder = 10 + F.col("p_partkey") % 5
    return table(spark, sf_dir, "part").where(F.col("p_size") <= reorder).select(
        F.col("p_partkey").alias("part_no"), F.col("p_size").alias("on_hand"), reorder.alias("reorder_point")
    )


@query(
    "wo_completion",
    "SELECT o_orderpriority AS priority, count(*) AS n, round(count(*) FILTER (WHERE o_orderstatus = 'F') * 1.0 / count(*), 6) AS completion, max(o_orderdate) FILTER (WHERE o_orderstatus = 'O') IS NOT NULL AS has_open FROM orders GROUP BY 1",
)
def wo_completion(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count("*").alias("n"),
        F.round(F.count_if(F.col("o_orderstatus") == "F") / F.count("*"), 6).alias("completion"),
        (F.count_if(F.col("o_orderstatus") == "O") > 0).alias("has_open")
    )


@query(
    "availability_kpi",
    """WITH g AS (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)
SELECT user_id AS asset_id, round(100.0 * sum(gap) FILTER (WHERE gap <= 86400000000) / sum(gap), 6) AS uptime_pct, round(avg(gap) / 3600000000, 6) AS hours_between FROM g GROUP BY user_id HAVING sum(gap) > 0""",
)
def availability_kpi(spark, sf_dir):
    """Share of time without a silence of over a day, and hours between rows."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros("ts")
    rows = events(spark, sf_dir).withColumn("gap", us - F.lag(us).over(w)).groupBy(F.col("user_id").alias("asset_id"))
    up = F.sum(F.when(F.col("gap") <= 86_400_000_000, F.col("gap")))
    return rows.agg(
        F.sum("gap").alias("all"),
        F.round(100.0 * up / F.nullif(F.sum("gap"), F.lit(0)), 6).alias("uptime_pct"),
        F.round(F.avg("gap") / 3_600_000_000, 6).alias("hours_between")
    ).where(F.col("all") > 0).drop("all")


@query(
    "health_score",
    """WITH l AS (SELECT user_id, arg_max(value, struct_pack(a := ts, b := event_id)) FILTER (WHERE event_type = 'view') AS a, arg_max(value, struct_pack(a := ts, b := event_id)) FILTER (WHERE event_type = 'error') AS b FROM events GROUP BY user_id)
SELECT user_id AS asset_id, round(greatest(0, 100 - (0.1 * coalesce(a, 0) + 0.2 * coalesce(b, 0))), 6) AS health, CASE WHEN 100 - (0.1 * coalesce(a, 0) + 0.2 * coalesce(b, 0)) >= 80 THEN 'green' WHEN 100 - (0.1 * coalesce(a, 0) + 0.2 * coalesce(b, 0)) >= 50 THEN 'yellow' ELSE 'red' END AS colour FROM l""",
)
def health_score(spark, sf_dir):
    """Weighted health of each asset from its latest values; weights and colours are settings."""
    last = lambda kind: F.coalesce(F.max_by(F.when(F.col("event_type") == kind, F.col("value")), F.when(F.col("event_type") == kind, F.struct("ts", "event_id"))), F.lit(0.0))
    rows = events(spark, sf_dir).groupBy(F.col("user_id").alias("asset_id")).agg(
        (100 - (0.1 * last("view") + 0.2 * last("error"))).alias("h")
    )
    return rows.select(
        "asset_id",
        F.round(F.greatest(F.lit(0.0), F.col("h")), 6).alias("health"),
        F.when(F.col("h") >= 80, "green").when(F.col("h") >= 50, "yellow").otherwise("red").alias("colour")
    )


@query(
    "fleet_overview",
    """SELECT r_name AS site, n_name AS area, count(*) AS assets, round(avg(s_acctbal), 4) AS mean_health, CAST(grouping(r_name) * 2 + grouping(n_name) AS BIGINT) AS level
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""",
)
def fleet_overview(spark, sf_dir):
    """Assets and health by site and area with totals."""
    area = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    rows = table(spark, sf_dir, "supplier").join(area, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.rollup(F.col("r_name").alias("site"), F.col("n_name").alias("area")).agg(
        F.count("*").alias("assets"),
        F.round(F.avg("s_acctbal"), 4).alias("mean_health"),
        F.grouping_id().alias("level")
    )


@query(
    "workorder_filter",
    "SELECT o_orderkey AS wo_id, o_custkey AS assignee, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority LIKE '1%' AND o_orderdate >= TIMESTAMP '1998-01-01'"
)
def workorder_filter(spark, sf_dir):
    """Open urgent work orders since a date: all three conditions reach the scan."""
    rows = table(spark, sf_dir, "orders").where(
        "o_orderstatus = 'O' and o_orderpriority like '1%' and o_orderdate >= timestamp_ntz'1998-01-01'"
    )
    return rows.select(
        F.col("o_orderkey").alias("wo_id"),
        F.col("o_custkey").alias("assignee"),
        F.col("o_orderpriority").alias("priority")
    )


@query(
    "technician_view",
    "SELECT o_orderkey AS wo_id, o_totalprice AS cost FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)"
)
def technician_view(spark, sf_dir):
    """A technician sees only the assets assigned to them."""
    own = table(spark, sf_dir, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(own, "o_custkey", "left_semi").select(
        F.col("o_orderkey").alias("wo_id"), F.col("o_totalprice").alias("cost")
    )


@query(
    "criticality_page",
    "SELECT s_suppkey AS asset_id, 1 + s_suppkey % 5 AS criticality FROM supplier ORDER BY 1 + s_suppkey % 5 DESC, s_suppkey LIMIT 20 OFFSET 10"
)
def criticality_page(spark, sf_dir):
    """The second half page of assets by criticality."""
    level = 1 + F.col("s_suppkey") % 5
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("asset_id"), level.alias("criticality")
    ).orderBy(F.desc("criticality"), "asset_id").offset(10).limit(20)


@query(
    "schedule_deviation",
    "SELECT l_suppkey AS asset_id, round(avg(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) - 60), 6) + 0.0 AS mean_deviation_days FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey",
)
def schedule_deviation(spark, sf_dir):
    """Mean days of completion against a plan of 60 days."""
    rows = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return rows.groupBy(F.col("l_suppkey").alias("asset_id")).agg(
        tidy(F.avg(F.date_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate")) - 60)).alias("mean_deviation_days")
    )


@query(
    "audit_changes",
    """WITH a AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus, o_orderpriority, lag(o_orderstatus) OVER w AS s, lag(o_orderpriority) OVER w AS p FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey AS id, concat_ws(',', CASE WHEN o_orderpriority <> p THEN 'priority' END, CASE WHEN o_orderstatus <> s THEN 'status' END) AS changed FROM a WHERE s IS NOT NULL""",
)
def audit_changes(spark, sf_dir):
    """Fields that differ from the version before, by a map of old and new values."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    new = F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("status"), F.col("o_orderstatus"))
    rows = table(spark, sf_dir, "orders").withColumn("new", new).withColumn(
        "p", F.lag("o_orderpriority").over(w)
    ).withColumn("s", F.lag("o_orderstatus").over(w)).where("s is not null")
    old = F.create_map(F.lit("priority"), F.col("p"), F.lit("status"), F.col("s"))
    diff = F.map_filter("new", lambda k, v: v != F.element_at("old", k))
    return rows.withColumn("old", old).select(
        F.col("o_orderkey").alias("id"), F.array_join(F.array_sort(F.map_keys(diff)), ",").alias("changed")
    )
