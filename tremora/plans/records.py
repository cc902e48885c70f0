"""Lookups, imports, upserts, escalation, searches and records around assets, alerts and diagnoses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tremora.functions import dsp
from tremora.functions.features import tidy
from tremora.operators import alerts as A
from tremora.operators.privacy import private_mean
from tremora.operators.search import score_terms
from tremora.plans.registry import events, query, stamp
from tremora.session import cut, scratch, table
from tremora.sources import io, objects

MINUTE = 60_000_000


@query(
    "waveform_range_fetch",
    "SELECT vec_id, 'waveforms/' || label || '/' || vec_id AS path, round(list_sum(list_transform(embedding[17:32], lambda v: CAST(v AS DOUBLE))), 6) + 0.0 AS total FROM embeddings WHERE label = 3",
)
def waveform_range_fetch(spark, sf_dir):
    """A quarter of each waveform of one machine, read by offset: the filter leads to that machine's index and objects,
    and only the bytes of the quarter are read. Objects are imported once, not by the query.
    """
    waves = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("machine"), F.col("vec_id").alias("key"), F.col("embedding").alias("samples")
    )
    found = objects.waveform_ranges(spark, objects.stored(spark, sf_dir, waves), 16, 32).where("machine = 3")
    path = F.concat_ws("/", F.lit("waveforms"), "machine", "key")
    return found.select(
        F.col("key").alias("vec_id"), path.alias("path"), tidy(dsp.total(dsp.doubles(F.col("samples")))).alias("total")
    )


@query("csv_import", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_import(spark, sf_dir):
    """A spreadsheet export read under a declared schema; rows that don't fit it go to quarantine."""
    path = scratch(spark, "csv")
    table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_name", "s_nationkey", "s_acctbal"
    ).write.option("header", True).csv(path)
    good, _ = io.csv_rows(spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    return good


@query(
    "alert_upsert",
    """SELECT user_id AS device_id, count(*) AS versions, max(event_id) FILTER (WHERE ts = m) AS alert_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS m FROM events WHERE event_type = 'error') GROUP BY user_id""",
)
def alert_upsert(spark, sf_dir):
    """The alert table after a batch of later versions was merged into it: one row a device, the latest version wins."""
    rows = events(spark, sf_dir).where("event_type = 'error'").select(
        F.col("user_id").alias("device_id"), "ts", F.col("event_id").alias("alert_id")
    )
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
    count = lambda r: r.groupBy("device_id").agg(F.count("*").alias("versions"), F.max_by("alert_id", F.struct("ts", "alert_id")).alias("alert_id"), F.max("ts").alias("ts"))
    merged = io.upsert(
        count(rows.where(~late)), count(rows.where(late)), ["device_id"], ["ts", "alert_id"], {"versions": F.sum}
    )
    return merged.select("device_id", "versions", "alert_id")


@query(
    "parts_suggestion",
    """WITH u AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), w AS (SELECT l_suppkey AS asset_id, arg_max(l_partkey, struct_pack(q := q, k := -l_partkey)) AS bearing FROM u GROUP BY l_suppkey),
s AS (SELECT asset_id, bearing, c.p_partkey AS part_id, c.p_retailprice AS price, row_number() OVER (PARTITION BY asset_id ORDER BY c.p_retailprice, c.p_partkey) AS place
FROM w JOIN part b ON bearing = b.p_partkey JOIN part c ON c.p_type = b.p_type AND c.p_partkey <> b.p_partkey AND abs(c.p_size - b.p_size) <= 10) SELECT asset_id, bearing, part_id, price, place FROM s WHERE place <= 3""",
)
def parts_suggestion(spark, sf_dir):
    """The three cheapest parts of the type and near the size of the bearing that an asset wears most."""
    used = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    worn = used.groupBy(F.col("l_suppkey").alias("asset_id")).agg(
        F.max_by("l_partkey", F.struct("q", -F.col("l_partkey"))).alias("bearing")
    )
    parts = table(spark, sf_dir, "part")
    own = parts.select(F.col("p_partkey").alias("bearing"), "p_type", F.col("p_size").alias("size"))
    # the four cheapest of each type and size are all that three others can come from
    cheap = F.slice(F.array_sort(F.collect_list(F.struct(F.col("p_retailprice").alias("price"), F.col("p_partkey").alias("part_id")))), 1, 4)
    near = parts.groupBy("p_type", "p_size").agg(cheap.alias("cheap"))
    sizes = F.explode(F.sequence(F.col("size") - 10, F.col("size") + 10)).alias("p_size")
    found = worn.join(own, "bearing").select("asset_id", "bearing", "p_type", sizes).join(near, ["p_type", "p_size"])
    found = found.select("asset_id", "bearing", F.inline("cheap")).where("part_id <> bearing")
    place = F.row_number().over(Window.partitionBy("asset_id").orderBy("price", "part_id")).cast("long")
    return found.withColumn("place", place).where("place <= 3").select(
        "asset_id", "bearing", "part_id", "price", "place"
    )


@query(
    "device_event_order",
    "SELECT user_id AS device_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events"
)
def device_event_order(spark, sf_dir):
    """Events of each device in order: dealt and sorted once, and numbered in that order."""
    rows = events(spark, sf_dir).repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    return rows.select(
        F.col("user_id").alias("device_id"),
        "event_id",
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("place")
    )


@query(
    "message_search",
    """WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM conversations), f AS (SELECT conv_id, turn, term, count(*) AS tf FROM t WHERE term IN ('the', 'and', 'with') GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM f GROUP BY term), n AS (SELECT count(*) AS n FROM conversations) SELECT conv_id, turn, round(sum((1 + ln(tf)) * ln(1 + n / df)), 5) AS score FROM f JOIN d USING (term), n GROUP BY conv_id, turn""",
)
def message_search(spark, sf_dir):
    """Messages that hold any of the words, by weighted frequency."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return score_terms(
        rows, ["conv_id", "turn"], "text", ["the", "and", "with"]
    ).select("conv_id", "turn", F.round("score", 5).alias("score"))


@query(
    "diagnosis_prompt",
    """WITH l AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id AS asset_id, 'asset ' || user_id || ' class ' || max(event_type) FILTER (WHERE k = 1) || ' severity ' || CASE WHEN max(value) FILTER (WHERE k = 1) >= 250 THEN 'P1' WHEN max(value) FILTER (WHERE k = 1) >= 120 THEN 'P2' ELSE 'P3' END
 || ' history ' || string_agg(event_type || '#' || event_id, ', ' ORDER BY k) AS prompt FROM l WHERE k <= 3 GROUP BY user_id""",
)
def diagnosis_prompt(spark, sf_dir):
    """The text that a maintenance assistant is given: class, severity and the last three events."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    rows = events(spark, sf_dir).withColumn("k", place).where("k <= 3")
    last = F.max_by(F.struct("event_type", "value"), -F.col("k"))
    history = F.transform(
        F.array_sort(F.collect_list(F.struct("k", F.concat_ws("#", "event_type", "event_id").alias("e")))),
        lambda s: s["e"]
    )
    found = rows.groupBy(F.col("user_id").alias("asset_id")).agg(
        last.alias("last"), F.array_join(history, ", ").alias("history")
    )
    level = A.severity(F.col("last.value"))
    return found.select(
        "asset_id",
        F.concat(
            F.lit("asset "),
            "asset_id",
            F.lit(" class "),
            "last.event_type",
            F.lit(" severity "),
            level,
            F.lit(" history "),
            "history"
        ).alias("prompt")
    )


@query(
    "column_encryption",
    "SELECT s_suppkey, s_name, CAST(octet_length(encode(s_name)) + 28 AS BIGINT) AS sealed_bytes, true AS opened FROM supplier"
)
def column_encryption(spark, sf_dir):
    """A column at rest under AES-256 in GCM mode, and what comes back. The key is read from the deployment's key file;
    neither code nor plan shows it.
    """
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(io.deployment_key(spark)))  # one row
    sealed = rows.select("s_suppkey", "s_name", "key", F.aes_encrypt("s_name", F.col("key")).alias("sealed"))
    opened = F.aes_decrypt("sealed", F.col("key")).cast("string")
    return sealed.select(
        "s_suppkey",
        opened.alias("s_name"),
        F.octet_length("sealed").cast("long").alias("sealed_bytes"),
        (opened == F.col("s_name")).alias("opened")
    )


@query(
    "cbor_payloads",
    "SELECT event_type AS channel, count(*) AS n, CAST(sum(floor(value * 100)) AS BIGINT) AS cents, CAST(sum(user_id % 200) AS BIGINT) AS keys FROM events GROUP BY event_type"
)
def cbor_payloads(spark, sf_dir):
    """Telemetry that comes as CBOR maps, {"v": hundredths, "k": number}, decoded and added up."""
    hexes = lambda x, n: F.lpad(F.hex(x.cast("long")), n, "0")
    payload = F.unhex(
        F.concat(
            F.lit("A261761A"), hexes(F.floor(F.col("value") * 100), 8), F.lit("616B18"), hexes(F.col("user_id") % 200, 2)
        )
    )
    rows = events(spark, sf_dir).select(F.col("event_type").alias("channel"), io.cbor_numbers(payload).alias("p"))
    return rows.groupBy("channel").agg(
        F.count("*").alias("n"),
        F.sum(F.col("p")["v"]).cast("long").alias("cents"),
        F.sum(F.col("p")["k"]).cast("long").alias("keys")
    )


@query(
    "diagnostic_record",
    """WITH e AS (SELECT vec_id, label, list_transform(embedding[1:12], lambda v: CAST(v AS DOUBLE)) AS c FROM embeddings)
SELECT vec_id AS event_id, label AS asset_id, CAST(list_position(c, list_max(c)) - 1 AS BIGINT) AS fault_class, round(list_max(c), 6) AS confidence, CASE WHEN list_max(c) >= 0.35 THEN 4 WHEN list_max(c) >= 0.25 THEN 3 WHEN list_max(c) >= 0.2 THEN 2 ELSE 1 END AS severity_stage,
 array_to_string(list_transform(list_filter(range(1, 13), lambda i: c[i] >= list_max(c) - 0.05), lambda i: 'part-' || (i - 1)), ',') AS parts, '{"event_id":' || vec_id || ',"asset_id":' || label || ',"fault_class":' || (list_position(c, list_max(c)) - 1) || '}' AS head FROM e""",
)
def diagnostic_record(spark, sf_dir):
    """The nested record of a diagnosis: class, confidence, stage and parts of the classes that come near."""
    c = F.col("c")
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("event_id"),
        F.col("label").alias("asset_id"),
        dsp.doubles(F.slice("embedding", 1, 12)).alias("c")
    )
    best = F.array_max(c)
    near = F.filter(F.sequence(F.lit(1), F.lit(12)), lambda i: F.element_at(c, i) >= best - 0.05)
    parts = F.transform(near, lambda i: F.concat(F.lit("part-"), (i - 1).cast("string")))
    stage = F.when(best >= 0.35, 4).when(best >= 0.25, 3).when(best >= 0.2, 2).otherwise(1)
    record = F.struct(
        "event_id",
        "asset_id",
        (F.array_position(c, best) - 1).alias("fault_class"),
        F.round(best, 6).alias("confidence"),
        stage.alias("severity_stage"),
        parts.alias("parts")
    )
    r = F.col("record")
    return rows.select(record.alias("record")).select(
        "record.event_id", "record.asset_id", "record.fault_class", "record.confidence", "record.severity_stage", F.array_join("record.parts", ",").alias("parts"),
        F.to_json(F.struct(r["event_id"].alias("event_id"), r["asset_id"].alias("asset_id"), r["fault_class"].alias("fault_class"))).alias("head"),
    )


ESCALATION_SQL = f"""WITH d AS (SELECT user_id, greatest(max(ts), (SELECT max(ts) - INTERVAL 24 HOURS FROM events)) AS seen FROM events GROUP BY user_id),
a AS (SELECT e.event_id, e.user_id, e.ts, (SELECT min(c.ts) FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'click' AND c.ts > e.ts) AS acked FROM events e WHERE event_type = 'error'),
s AS (SELECT level, CAST(minutes AS BIGINT) AS minutes FROM (VALUES (1, 60), (2, 240), (3, 1440)) t(level, minutes))
SELECT a.event_id AS alert_id, s.level FROM a JOIN d ON a.user_id = d.user_id, s WHERE epoch_us(a.ts) + s.minutes * {MINUTE} <= epoch_us(d.seen) AND (acked IS NULL OR epoch_us(acked) > epoch_us(a.ts) + s.minutes * {MINUTE})"""


def _escalation(spark, sf_dir, rules, site):
    """Levels under a rules table; a click acknowledges the alerts of its device that came before."""
    rows = events(spark, sf_dir).select("user_id", "event_id", "event_type", F.unix_micros("ts").alias("us"))
    last = rows.groupBy("user_id").agg(F.max("us").alias("seen"))
    horizon = F.broadcast(rows.agg((F.max("us") - 24 * 60 * MINUTE).alias("horizon")))  # one row
    seen = last.join(horizon).select("user_id", F.greatest("seen", "horizon").alias("seen"))
    alerts = rows.where("event_type = 'error'").select(
        "user_id", F.col("event_id").alias("alert_id"), "us", site.alias("site")
    )
    clicks = rows.where("event_type = 'click'").select("user_id", "us")
    return A.escalation(alerts, clicks, seen, rules, "user_id", "alert_id", "us", 24 * 60 * MINUTE)


STEPS = ((1, 60), (2, 240), (3, 1440))


@query("alert_escalation", ESCALATION_SQL)
def alert_escalation(spark, sf_dir):
    """Levels that each alert reached before a later click of the device acknowledged it: after one, four and 24
    hours.
    """
    rules = spark.createDataFrame([(0, k, m * MINUTE) for k, m in STEPS], "site long, level int, after_us long")
    return _escalation(spark, sf_dir, rules, F.lit(0).cast("long"))


ESCALATION_RULES_SQL = ESCALATION_SQL.replace(
    "s AS (SELECT level, CAST(minutes AS BIGINT) AS minutes FROM (VALUES", "s AS (SELECT level, CAST(minutes * (1 + r_regionkey) AS BIGINT) AS minutes, r_regionkey AS site FROM region, (VALUES"
).replace(", s WHERE", " JOIN s ON s.site = a.user_id % 5 WHERE")


def escalation_rules(spark, sf_dir):
    """(site, level, after_us): the rules of each region, as rows."""
    steps = F.inline(
        F.array(*(F.struct(F.lit(k).alias("level"), F.lit(m * MINUTE).cast("long").alias("after_us")) for k, m in STEPS))
    )
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("site"), steps)
    return rows.withColumn("after_us", F.col("after_us") * (1 + F.col("site")))


@query("alert_escalation_rules", ESCALATION_RULES_SQL)
def alert_escalation_rules(spark, sf_dir):
    """The same under rules that are rows of a table, those of the device's region."""
    return _escalation(spark, sf_dir, escalation_rules(spark, sf_dir), (F.col("user_id") % 5).cast("long"))


@query(
    "rul_interval",
    """WITH d AS (SELECT user_id, epoch(ts) / 86400 - 19723 AS d, value FROM events), f AS (SELECT user_id, count(*) AS n, regr_slope(value, d) AS s, regr_intercept(value, d) AS i, max(d) AS now, regr_syy(value, d) AS syy, regr_sxy(value, d) AS sxy FROM d GROUP BY user_id)
SELECT user_id AS asset_id, CASE WHEN round(s, 6) > 0 AND n > 2 THEN round((600 - i) / s - now, 4) END AS median_days, CASE WHEN round(s, 6) > 0 AND n > 2 THEN round((600 - i - 1.2816 * sqrt(greatest(syy - s * sxy, 0) / (n - 2))) / s - now, 3) END AS low_days,
 CASE WHEN round(s, 6) > 0 AND n > 2 THEN round((600 - i + 1.2816 * sqrt(greatest(syy - s * sxy, 0) / (n - 2))) / s - now, 3) END AS high_days FROM f""",
)
def rul_interval(spark, sf_dir):
    """Remaining life with an 80 percent interval: the line through the scores, moved by 1.28 residual deviations."""
    day = F.unix_micros("ts") / 86_400e6 - 19723
    rows = events(spark, sf_dir).withColumn("d", day).groupBy(F.col("user_id").alias("asset_id"))
    f = rows.agg(
        F.count("*").alias("n"),
        F.regr_slope("value", "d").alias("s"),
        F.regr_intercept("value", "d").alias("i"),
        F.max("d").alias("now"),
        F.regr_syy("value", "d").alias("syy"),
        F.regr_sxy("value", "d").alias("sxy")
    )
    spread = 1.2816 * F.sqrt(F.greatest(F.col("syy") - F.col("s") * F.col("sxy"), F.lit(0.0)) / (F.col("n") - 2))
    rising = (F.round("s", 6) > 0) & (F.col("n") > 2)
    at = lambda moved, places: F.when(rising, F.round((600 - F.col("i") + moved) / F.col("s") - F.col("now"), places))
    return f.select(
        "asset_id",
        at(F.lit(0.0), 4).alias("median_days"),
        at(-spread, 3).alias("low_days"),
        at(spread, 3).alias("high_days")
    )


@query(
    "rul_error_share",
    """WITH d AS (SELECT user_id, epoch(ts) / 86400 - 19723 AS d, value FROM events), f AS (SELECT user_id, regr_slope(value, d) AS s, regr_intercept(value, d) AS i FROM d WHERE d < 15 GROUP BY user_id),
a AS (SELECT user_id, min(d) - 15 AS actual FROM d WHERE d >= 15 AND value >= 200 GROUP BY user_id)
SELECT count(*) AS assets, round(avg(abs((200 - i) / s - 15 - actual)), 4) AS mae_days, round(sum(abs((200 - i) / s - 15 - actual)) / sum(actual), 5) AS share FROM f JOIN a USING (user_id) WHERE round(s, 6) > 0 AND actual > 0""",
)
def rul_error_share(spark, sf_dir):
    """Predictions from the first half of the month against the days that passed until the limit: mean error, and its
    share of the actual days.
    """
    rows = events(spark, sf_dir).select("user_id", "value", (F.unix_micros("ts") / 86_400e6 - 19723).alias("d"))
    line = rows.where("d < 15").groupBy("user_id").agg(
        F.regr_slope("value", "d").alias("s"), F.regr_intercept("value", "d").alias("i")
    )
    actual = rows.where("d >= 15 and value >= 200").groupBy("user_id").agg((F.min("d") - 15).alias("actual"))
    pairs = line.join(actual, "user_id").where((F.round("s", 6) > 0) & (F.col("actual") > 0))
    error = F.abs((200 - F.col("i")) / F.col("s") - 15 - F.col("actual"))
    return pairs.agg(
        F.count("*").alias("assets"),
        F.round(F.avg(error), 4).alias("mae_days"),
        F.round(F.sum(error) / F.sum("actual"), 5).alias("share")
    )


@query(
    "alarm_load",
    "SELECT round(count(*) FILTER (WHERE event_type = 'error') * 100.0 / (count(DISTINCT user_id) * count(DISTINCT strftime(ts, '%Y-%m-%d'))), 6) AS alarms_per_day_per_100 FROM events",
)
def alarm_load(spark, sf_dir):
    """Alarms a day and 100 assets."""
    found = events(spark, sf_dir).agg(
        F.count_if(F.col("event_type") == "error").alias("a"),
        F.countDistinct("user_id").alias("u"),
        F.countDistinct(F.date_format("ts", "yyyy-MM-dd")).alias("d")
    )
    return found.select(F.round(F.col("a") * 100.0 / (F.col("u") * F.col("d")), 6).alias("alarms_per_day_per_100"))


@query("federated_private_mean")
def federated_private_mean(spark, sf_dir):
    """The sites' means, clipped to a range and blurred by Laplace noise that is drawn anew for the round, weighted."""
    sites = events(spark, sf_dir).groupBy("user_id").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    return private_mean(sites, "m", "n", 50.0, 150.0, 2.0).select(F.round("mean", 5).alias("mean"))


@query(
    "severity_by_trend",
    """WITH d AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, avg(value) AS v, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT *, CASE WHEN count(*) OVER w > 1 THEN regr_slope(v, x) OVER w END AS s FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS DOUBLE) AS x FROM d) WINDOW w AS (PARTITION BY user_id ORDER BY x ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT user_id AS asset_id, day, CASE WHEN v >= 250 OR (v >= 150 AND coalesce(round(s, 6), 0) > 20) THEN 4 WHEN v >= 150 OR (v >= 100 AND coalesce(round(s, 6), 0) > 10) THEN 3 WHEN v >= 100 OR coalesce(round(s, 6), 0) > 20 THEN 2 ELSE 1 END AS stage, n >= 3 AS confident FROM t""",
)
def severity_by_trend(spark, sf_dir):
    """Stage 1 to 4 from the day's mean score and its trend over a week of days; confident with three scores or more."""
    days = events(spark, sf_dir).groupBy(
        F.col("user_id").alias("asset_id"), F.date_format("ts", "yyyy-MM-dd").alias("day")
    ).agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    days = days.withColumn("x", F.row_number().over(Window.partitionBy("asset_id").orderBy("day")).cast("double"))
    s = F.coalesce(
        F.round(F.regr_slope("v", "x").over(Window.partitionBy("asset_id").orderBy("x").rowsBetween(-6, 0)), 6),
        F.lit(0.0)
    )
    v, t = F.col("v"), F.col("t")
    stage = F.when(
        (v >= 250) | ((v >= 150) & (t > 20)), 4
    ).when((v >= 150) | ((v >= 100) & (t > 10)), 3).when((v >= 100) | (t > 20), 2).otherwise(1)
    return days.withColumn("t", s).select("asset_id", "day", stage.alias("stage"), (F.col("n") >= 3).alias("confident"))


@query(
    "latest_config",
    "SELECT o_custkey AS device_id, arg_max(o_orderpriority, struct_pack(a := o_orderdate, b := o_orderkey)) AS setting, count(*) AS versions FROM orders GROUP BY o_custkey"
)
def latest_config(spark, sf_dir):
    """The configuration in force on each device: the last of its versions."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("device_id")).agg(
        F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("setting"),
        F.count("*").alias("versions")
    )


@query(
    "tenant_view",
    "SELECT c_custkey AS tenant_id, o_orderkey AS order_id, o_totalprice AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"
)
def tenant_view(spark, sf_dir):
    """Rows of the tenants that the caller may see; the filter stands in the view, not in the query."""
    return io.tenant_rows(
        table(spark, sf_dir, "orders"),
        table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"),
        "o_custkey",
        "c_custkey"
    ).select(
        F.col("o_custkey").alias("tenant_id"),
        F.col("o_orderkey").alias("order_id"),
        F.col("o_totalprice").alias("total")
    )


@query(
    "compliance_delete",
    "SELECT event_type AS channel, count(*) AS n, count(DISTINCT user_id) AS devices FROM events WHERE user_id % 50 <> 7 GROUP BY event_type"
)
def compliance_delete(spark, sf_dir):
    """The telemetry table written again without the subjects that asked to be forgotten."""
    rows = table(spark, sf_dir, "events")
    subjects = rows.select("user_id").distinct().where("user_id % 50 = 7")
    left = io.without_subjects(rows, subjects, "user_id", scratch(spark, "kept"))
    return left.groupBy(F.col("event_type").alias("channel")).agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("devices")
    )


@query(
    "rule_table",
    """WITH r AS (SELECT * FROM (VALUES ('view', 'above', 300.0, 'hot'), ('click', 'above', 200.0, 'fast'), ('error', 'below', 20.0, 'weak')) t(channel, side, bound, name))
SELECT name AS rule, count(*) AS hits FROM events JOIN r ON event_type = channel WHERE (side = 'above' AND value > bound) OR (side = 'below' AND value < bound) GROUP BY name""",
)
def rule_table(spark, sf_dir):
    """Threshold rules as rows: edited as data, applied by one join."""
    rules = spark.createDataFrame(
        [("view", "above", 300.0, "hot"), ("click", "above", 200.0, "fast"), ("error", "below", 20.0, "weak")],
        "event_type string, side string, bound double, rule string"
    )
    hit = F.when(F.col("side") == "above", F.col("value") > F.col("bound")).otherwise(F.col("value") < F.col("bound"))
    return events(spark, sf_dir).join(
        F.broadcast(rules), "event_type"
    ).where(hit).groupBy("rule").agg(F.count("*").alias("hits"))


@query(
    "late_merge",
    "SELECT event_type AS channel, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
)
def late_merge(spark, sf_dir):
    """Daily sums in a table by day, into which rows that came late are merged: only the days that they touch are read
    and written again.
    """
    rows = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    late = F.col("event_id") % 10 == 3
    sums = lambda r: r.groupBy("event_type", "day").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    path = scratch(spark, "days")
    sums(rows.where(~late)).write.partitionBy("day").parquet(path)
    schema = "event_type string, n long, total double, day date"
    merged = io.merge_days(
        spark, path, schema, sums(rows.where(late)), ["event_type", "day"], {"n": F.sum, "total": F.sum}
    )
    return merged.select(
        F.col("event_type").alias("channel"),
        stamp(F.col("day").cast("timestamp")).alias("day"),
        "n",
        F.round("total", 4).alias("total")
    )


@query("fault_classifier")
def fault_classifier(spark, sf_dir):
    """A random forest on signal features of each window; a fifth of the windows is held out."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.feature import VectorAssembler

    x = F.col("x")
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null").select(
        "vec_id",
        F.col("label").cast("double").alias("label"),
        dsp.doubles(F.col("embedding")).alias("x"),
        dsp.rfft("embedding").alias("s")
    )
    names = ["rms", "peak", "mean", *(f"bin{k}" for k in range(1, 9)), *(f"x{k}" for k in range(16))]
    rows = rows.select(
        "vec_id",
        "label",
        dsp.array_rms(x).alias("rms"),
        dsp.array_peak(x).alias("peak"),
        dsp.array_mean(x).alias("mean"),
        *(F.col("s")[k].alias(f"bin{k}") for k in range(1, 9)),
        *(x[k].alias(f"x{k}") for k in range(16))
    )
    table_ = VectorAssembler(
        inputCols=names, outputCol="features", handleInvalid="skip"
    ).transform(cut(rows, "features"))
    held = F.col("vec_id") % 5 == 0
    train = table_.where(~held)
    if train.isEmpty():
        return rows.select(
            "vec_id", F.lit(0).cast("long").alias("fault_class"), F.lit(0.0).alias("confidence"), held.alias("held_out")
        ).limit(0)
    model = RandomForestClassifier(numTrees=40, maxDepth=8, seed=7).fit(train)
    p = vector_to_array("probability")
    return model.transform(table_).select(
        "vec_id",
        F.col("prediction").cast("long").alias("fault_class"),
        F.round(F.array_max(p), 6).alias("confidence"),
        held.alias("held_out")
    )
