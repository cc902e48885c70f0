"""Smaller reads and rules on assets, devices and captures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremora.functions import dsp
from tremora.functions.features import tidy
from tremora.plans.registry import events, query
from tremora.plans.signal import _amplitude, _waves, _WAVES
from tremora.session import table


@query(
    "capture_trigger",
    "SELECT user_id AS device_id, count(*) AS captures FROM events WHERE value > 300 OR event_id % 24 = 0 GROUP BY user_id"
)
def capture_trigger(spark, sf_dir):
    """Captures by anomaly or by schedule."""
    return events(spark, sf_dir).where(
        (F.col("value") > 300) | (F.col("event_id") % 24 == 0)
    ).groupBy(F.col("user_id").alias("device_id")).agg(F.count("*").alias("captures"))


@query(
    "stopped_machine_throttle",
    "SELECT user_id AS device_id, count(*) AS sent FROM events WHERE event_id % 7 <> 0 GROUP BY user_id"
)
def stopped_machine_throttle(spark, sf_dir):
    """Rows of running machines only; a speed of zero sends nothing."""
    rpm = F.col("event_id") % 7
    return events(spark, sf_dir).withColumn("rpm", rpm).where("rpm > 0").groupBy(
        F.col("user_id").alias("device_id")
    ).agg(F.count("*").alias("sent"))


@query(
    "low_battery",
    "SELECT user_id AS device_id, min(CAST(props ->> '$.k' AS BIGINT)) AS battery_pct FROM events GROUP BY user_id HAVING min(CAST(props ->> '$.k' AS BIGINT)) < 15"
)
def low_battery(spark, sf_dir):
    """Devices whose battery fell below 15 percent."""
    level = F.get_json_object("props", "$.k").cast("long")
    return events(spark, sf_dir).groupBy(
        F.col("user_id").alias("device_id")
    ).agg(F.min(level).alias("battery_pct")).where("battery_pct < 15")


@query(
    "rpm_normalised",
    "SELECT user_id AS device_id, round(avg(value / ((600 + user_id % 7 * 300) / 60.0)), 6) AS per_turn FROM events GROUP BY user_id"
)
def rpm_normalised(spark, sf_dir):
    """Feature per shaft turn."""
    rpm = 600 + F.col("user_id") % 7 * 300
    return events(spark, sf_dir).groupBy(F.col("user_id").alias("device_id")).agg(
        F.round(F.avg(F.col("value") / (rpm / 60.0)), 6).alias("per_turn")
    )


@query(
    "waveform_paths",
    "SELECT event_id, 'waveforms/' || user_id || '/' || strftime(ts, '%Y%m%dT%H%M%S') || '/x_axis.bin' AS path FROM events WHERE event_type = 'view'"
)
def waveform_paths(spark, sf_dir):
    """Object paths of captures."""
    path = F.concat(
        F.lit("waveforms/"),
        F.col("user_id").cast("string"),
        F.lit("/"),
        F.date_format("ts", "yyyyMMdd'T'HHmmss"),
        F.lit("/x_axis.bin")
    )
    return events(spark, sf_dir).where("event_type = 'view'").select("event_id", path.alias("path"))


@query("package_digest", "SELECT s_suppkey AS asset_id, sha256(s_name) AS digest FROM supplier")
def package_digest(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("asset_id"), F.sha2("s_name", 256).alias("digest")
    )


@query(
    "asset_attributes",
    "SELECT p_partkey AS asset_id, p_brand AS brand, CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) END AS large_size FROM part WHERE p_type LIKE '%A%'"
)
def asset_attributes(spark, sf_dir):
    """Custom attributes as a map, filtered and read by key."""
    pairs = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    kept = F.map_filter(pairs, lambda k, v: (k != "size") | (v.cast("int") > 25))
    return table(spark, sf_dir, "part").where("p_type like '%A%'").select(
        F.col("p_partkey").alias("asset_id"), kept.alias("m")
    ).select(
        "asset_id", F.col("m")["brand"].alias("brand"), F.try_element_at("m", F.lit("size")).alias("large_size")
    )


@query("compliance_export", "SELECT * FROM (SELECT event_id, event_type, value FROM events WHERE user_id = 2)")
def compliance_export(spark, sf_dir):
    """Everything held about one subject."""
    return events(spark, sf_dir).where("user_id = 2").select("event_id", "event_type", "value")


@query(
    "active_devices",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS devices FROM events GROUP BY 1"
)
def active_devices(spark, sf_dir):
    return events(spark, sf_dir).groupBy(
        F.date_format("ts", "yyyy-MM-dd").alias("day")
    ).agg(F.countDistinct("user_id").alias("devices"))


@query(
    "pm_calendar",
    """WITH t AS (SELECT o_custkey AS asset_id, o_orderkey % 50 AS technician, CAST(o_orderdate AS DATE) + CAST(90 AS INTEGER) AS due FROM orders WHERE o_orderstatus <> 'F')
SELECT technician, strftime(due, '%Y-%m') AS month, count(*) AS tasks, count(DISTINCT asset_id) AS assets FROM t GROUP BY ALL""",
)
def pm_calendar(spark, sf_dir):
    """Tasks that fall due 90 days after their order, by technician and month."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(
        F.col("o_custkey").alias("asset_id"),
        (F.col("o_orderkey") % 50).alias("technician"),
        F.date_add(F.to_date("o_orderdate"), 90).alias("due")
    )
    return rows.groupBy("technician", F.date_format("due", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("tasks"), F.countDistinct("asset_id").alias("assets")
    )


@query(
    "stator_harmonics",
    f"""WITH {_WAVES}, a AS (SELECT label, {_amplitude("3")} AS a3, {_amplitude("9")} AS a9, {_amplitude("15")} AS a15 FROM x)
SELECT label AS machine, round(avg(a9 / nullif(a3, 0)), 6) AS third, round(avg(a15 / nullif(a3, 0)), 6) AS fifth FROM a GROUP BY label""",
)
def stator_harmonics(spark, sf_dir):
    """Third and fifth harmonics against the supply line."""
    a = {k: dsp.amplitude(F.col("x"), F.lit(float(k))) for k in (3, 9, 15)}
    rows = _waves(spark, sf_dir).select(F.col("label").alias("machine"), *(c.alias(f"a{k}") for k, c in a.items()))
    ratio = lambda k: F.round(F.avg(F.col(f"a{k}") / F.nullif("a3", F.lit(0.0))), 6)
    return rows.groupBy("machine").agg(ratio(9).alias("third"), ratio(15).alias("fifth"))


@query(
    "bearing_current_sidebands",
    f"""WITH {_WAVES}, k AS (SELECT vec_id, x, unnest([1, 2]) AS k FROM x) SELECT vec_id, CAST(k AS INTEGER) AS k, round({_amplitude("abs(60 - k * 24.4) * len(x) / 640.0")}, 6) AS lower_amplitude, round({_amplitude("(60 + k * 24.4) * len(x) / 640.0")}, 6) AS upper_amplitude FROM k""",
)
def bearing_current_sidebands(spark, sf_dir):
    """Lines at the supply frequency plus and minus multiples of an outer-race frequency."""
    rows = _waves(spark, sf_dir).select("vec_id", "x", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    at = lambda f: F.round(dsp.at_frequency(F.col("x"), f, F.lit(640.0)), 6)
    return rows.select(
        "vec_id",
        "k",
        at(F.abs(60 - F.col("k") * 24.4)).alias("lower_amplitude"),
        at(60 + F.col("k") * 24.4).alias("upper_amplitude")
    )


@query(
    "supply_frequency",
    f"""WITH {_WAVES}, b AS (SELECT vec_id, x, unnest(range(3, 7)) AS k FROM x), a AS (SELECT vec_id, k, round({_amplitude("k")}, 9) AS a FROM b) SELECT vec_id, CAST(arg_max(k, struct_pack(a := a, k := k)) AS DOUBLE) * 10 AS hz FROM a GROUP BY vec_id""",
)
def supply_frequency(spark, sf_dir):
    """The strongest line within the range of supply frequencies."""
    bins = _waves(spark, sf_dir).select("vec_id", "x", F.explode(F.sequence(F.lit(3), F.lit(6))).alias("k")).select(
        "vec_id", "k", F.round(dsp.amplitude(F.col("x"), F.col("k").cast("double")), 9).alias("a")
    )
    return bins.groupBy("vec_id").agg((F.max_by("k", F.struct("a", "k")) * 10.0).alias("hz"))


@query(
    "boot_self_test",
    f"""WITH {_WAVES} SELECT vec_id, round(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)), 6) < 0.13 AS passed FROM x"""
)
def boot_self_test(spark, sf_dir):
    """Noise floor of a quiet capture against its limit."""
    return _waves(spark, sf_dir).select("vec_id", (F.round(dsp.array_rms(F.col("x")), 6) < 0.13).alias("passed"))


@query(
    "counterfactual_linear",
    "SELECT vec_id, round((0.3 - (0.5 * CAST(embedding[1] AS DOUBLE) - 0.2 * CAST(embedding[2] AS DOUBLE))) / 0.5, 6) + 0.0 AS change_f1 FROM embeddings WHERE round(0.5 * CAST(embedding[1] AS DOUBLE) - 0.2 * CAST(embedding[2] AS DOUBLE), 9) > 0.05",
)
def counterfactual_linear(spark, sf_dir):
    """The change of the first feature that brings a linear score to the limit."""
    a, b = (F.col("embedding")[i].cast("double") for i in (0, 1))
    score = 0.5 * a - 0.2 * b
    return table(spark, sf_dir, "embeddings").where(F.round(score, 9) > 0.05).select(
        "vec_id", tidy((0.3 - score) / 0.5).alias("change_f1")
    )


@query(
    "dataset_fusion",
    """WITH w AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS part, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings),
s AS (SELECT * FROM w UNION ALL SELECT 'synthetic', label, list_transform(list_reverse(x), lambda v, i: v * (1 + 0.1 * sin(i - 1))) FROM w WHERE label = 3)
SELECT part, count(*) AS windows, count(DISTINCT label) AS bearings, round(avg(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x))), 6) AS rms FROM s GROUP BY part""",
)
def dataset_fusion(spark, sf_dir):
    """Several labelled sets and windows that are made for a rare class, as one set: its windows turned round in time
    with a swell.
    """
    part = F.when(F.col("vec_id") % 2 == 0, "a").otherwise("b")
    rows = table(spark, sf_dir, "embeddings").select(
        part.alias("part"), "label", dsp.doubles(F.col("embedding")).alias("x")
    )
    swell = F.transform(F.reverse("x"), lambda v, i: v * (1 + 0.1 * F.sin(i.cast("double"))))
    made = rows.where("label = 3").select(F.lit("synthetic").alias("part"), "label", swell.alias("x"))
    return rows.unionByName(made).groupBy("part").agg(
        F.count("*").alias("windows"),
        F.countDistinct("label").alias("bearings"),
        F.round(F.avg(dsp.array_rms(F.col("x"))), 6).alias("rms")
    )
