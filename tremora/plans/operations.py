"""Imports, sinks, retention, cascades, registries and further reads of signals."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.functions import dsp
from tremora.functions.features import tidy
from tremora.operators.ranks import numbered, running
from tremora.operators.temporal import asof, interval
from tremora.plans.registry import SQL, events, query
from tremora.plans.signal import _WAVES, _filtered_sql
from tremora.plans.spectra import FRAME, _FRAMES, _frames
from tremora.session import scratch, table
from tremora.sources import io
from tremora.streaming import jobs


@query("bearing_catalogue_import", SQL["bearing_frequencies"])
def bearing_catalogue_import(spark, sf_dir):
    """Defect frequencies from a catalogue of geometry that comes as CSV."""
    path = scratch(spark, "catalogue")
    geometry = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("bearing_id"),
        (8 + F.col("p_size") % 5).alias("balls"),
        (F.col("p_size") / 10.0).alias("ball"),
        (F.col("p_retailprice") / 10.0 + 20).alias("pitch")
    )
    geometry.write.option("header", True).csv(path)
    rows, _ = io.csv_rows(spark, path, "bearing_id long, balls int, ball double, pitch double")
    found = dsp.bearing_frequencies(F.lit(1800.0), F.col("balls"), F.col("ball"), F.col("pitch"), F.lit(15.0))
    return rows.select("bearing_id", *(F.round(c, 6).alias(n) for n, c in found.items()))


@query(
    "metric_sink_idempotent",
    "SELECT event_type AS channel, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL"
)
def metric_sink_idempotent(spark, sf_dir):
    """Daily metrics written twice to a table partitioned by day: a batch that runs again replaces its own days."""
    path = scratch(spark, "metrics")
    days = events(spark, sf_dir).groupBy(
        F.col("event_type").alias("channel"), F.date_format("ts", "yyyy-MM-dd").alias("day")
    ).agg(F.count("*").alias("n"))
    for rows in (days, days.where("day >= '2024-01-10'")):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    return spark.read.schema("channel string, n long, day string").parquet(path).select("channel", "day", "n")


@query(
    "waveform_sink_trigger",
    "SELECT CASE WHEN list_max(list_transform(embedding, lambda v: abs(v))) > 0.3 THEN 'anomaly' ELSE 'schedule' END AS reason, count(*) AS stored, CAST(sum(len(embedding)) AS BIGINT) AS samples FROM embeddings WHERE list_max(list_transform(embedding, lambda v: abs(v))) > 0.3 OR vec_id % 24 = 0 GROUP BY 1",
)
def waveform_sink_trigger(spark, sf_dir):
    """Waveforms kept on a trigger or on schedule, in folders by reason; read back from there."""
    path = scratch(spark, "objects")
    peak = F.array_max(F.transform("embedding", F.abs))
    rows = table(spark, sf_dir, "embeddings").withColumn("peak", peak).where(
        (F.col("peak") > F.lit(0.3).cast("float")) | (F.col("vec_id") % 24 == 0)
    )
    rows.select(
        "vec_id",
        "embedding",
        F.when(F.col("peak") > F.lit(0.3).cast("float"), "anomaly").otherwise("schedule").alias("reason")
    ).write.partitionBy("reason").parquet(path)
    return spark.read.schema("vec_id long, embedding array<float>, reason string").parquet(path).groupBy("reason").agg(
        F.count("*").alias("stored"), F.sum(F.size("embedding")).alias("samples")
    )


@query(
    "retention_drop",
    "SELECT event_type AS channel, count(*) AS n FROM events WHERE CAST(ts AS DATE) > (SELECT CAST(max(ts) AS DATE) - 7 FROM events) GROUP BY event_type"
)
def retention_drop(spark, sf_dir):
    """Raw telemetry after seven days: whole partitions are dropped, no row is rewritten."""
    path = scratch(spark, "raw")
    events(spark, sf_dir).select(
        "event_id", "event_type", F.to_date("ts").alias("day")
    ).write.partitionBy("day").parquet(path)
    io.drop_partitions(spark, path, "day", 7)
    return spark.read.schema(
        "event_id long, event_type string, day date"
    ).parquet(path).groupBy(F.col("event_type").alias("channel")).agg(F.count("*").alias("n"))


@query(
    "cascade_scoring",
    "SELECT event_id, round(sqrt(value) * 3 - 20, 6) AS score FROM events WHERE value > 120 AND value * (1 + user_id % 3) > 300",
)
def cascade_scoring(spark, sf_dir):
    """A costly score behind two cheap gates: the Arrow function sees only what passed both."""

    @F.arrow_udf(T.DoubleType())
    def costly(value: pa.Array) -> pa.Array:
        return pa.array(value.to_numpy(zero_copy_only=False) ** 0.5 * 3 - 20)

    gated = events(spark, sf_dir).where("value > 120").where(F.col("value") * (1 + F.col("user_id") % 3) > 300)
    return gated.select("event_id", F.round(costly("value"), 6).alias("score"))


@query(
    "ecdf_baseline",
    """WITH b AS (SELECT event_type, value FROM events WHERE ts < TIMESTAMP '2024-01-16'), n AS (SELECT event_type, count(*) AS n FROM b GROUP BY event_type)
SELECT event_id, round((SELECT count(*) FROM b WHERE b.event_type = e.event_type AND b.value <= e.value) * 1.0 / n.n, 6) AS share FROM events e JOIN n ON n.event_type = e.event_type WHERE ts >= TIMESTAMP '2024-01-16'""",
)
def ecdf_baseline(spark, sf_dir):
    """Share of the baseline's values at or below each later value: ranks of the baseline, joined as of the value."""
    rows = events(spark, sf_dir)
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
    levels = running(
        rows.where(~late).groupBy("event_type", "value").agg(F.count("*").alias("c")), ["event_type"], "value", "c"
    )
    below = levels.select("event_type", "value", (F.col("__before") + F.col("c")).alias("upto"))
    totals = levels.groupBy("event_type").agg(F.sum("c").alias("n"))
    found = asof(
        rows.where(late).select("event_id", "event_type", "value"), below, ["event_type"], "value", ["upto"]
    ).join(totals, "event_type")
    return found.select("event_id", F.round(F.coalesce("upto", F.lit(0)) / F.col("n"), 6).alias("share"))


_HANN = "list_transform(y, lambda v, i: v * 0.5 * (1 - cos(2 * pi() * (i - 1) / len(y))))"


@query(
    "averaged_spectrum",
    f"""WITH {_FRAMES}, h AS (SELECT vec_id, {_HANN} AS y FROM y), k AS (SELECT vec_id, unnest(range(1, {FRAME // 2})) AS bin, y FROM h),
p AS (SELECT vec_id, bin, (pow(list_sum(list_transform(y, lambda v, i: v * cos(2 * pi() * bin * (i - 1) / {FRAME}))), 2) + pow(list_sum(list_transform(y, lambda v, i: v * sin(2 * pi() * bin * (i - 1) / {FRAME}))), 2)) AS p FROM k)
SELECT vec_id, bin, round(2 * sqrt(avg(p)) / {FRAME} / 0.5, 5) + 0.0 AS amplitude, round(2 * avg(p) / ({FRAME} * {FRAME}) / 0.25 / 1.5, 7) + 0.0 AS density FROM p GROUP BY ALL""",
)
def averaged_spectrum(spark, sf_dir):
    """Power averaged over Hann frames: amplitude with the window's coherent gain 0.5, density per bin with its noise
    bandwidth of 1.5 bins.
    """
    bins = _frames(spark, sf_dir).select(
        "vec_id", F.posexplode(F.slice(dsp.rfft(dsp.hann(F.col("y"))), 2, FRAME // 2 - 1)).alias("at", "a")
    )
    power = F.avg(F.col("a") * F.col("a"))
    return bins.groupBy("vec_id", (F.col("at") + 1).cast("long").alias("bin")).agg(
        tidy(F.sqrt(power) / 0.5, 5).alias("amplitude"), tidy(power / 2 / 0.25 / 1.5, 7).alias("density")
    )


_SLOW = dsp.band_taps(0.0, 0.125, 1.0, 63)
_SLOW_SQL = "[" + ", ".join(repr(float(h)) + "::DOUBLE" for h in _SLOW / _SLOW.sum()) + "]"


@query(
    "decimated_rms",
    f"""WITH {_WAVES}, f AS (SELECT vec_id, {_filtered_sql("x", _SLOW_SQL, 63)} AS y FROM x), d AS (SELECT vec_id, list_filter(y, lambda v, i: (i - 1) % 4 = 0) AS y FROM f)
SELECT vec_id, CAST(len(y) AS INTEGER) AS samples, round(sqrt(list_sum(list_transform(y, lambda v: v * v)) / len(y)), 6) AS rms FROM d""",
)
def decimated_rms(spark, sf_dir):
    """A quarter of the sampling rate behind an anti-alias low-pass."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", dsp.decimated(4)("embedding").alias("y"))
    return rows.select("vec_id", F.size("y").alias("samples"), F.round(dsp.array_rms(F.col("y")), 6).alias("rms"))


@query(
    "long_spectrum",
    """WITH c AS (SELECT label, (k - 1) // 1024 AS block, flatten(list(embedding ORDER BY vec_id)) AS x FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings) GROUP BY ALL),
p AS (SELECT label, block, list_transform(x[1 : CAST(pow(2, floor(log2(len(x)))) AS BIGINT)], lambda v: CAST(v AS DOUBLE)) AS x FROM c), b AS (SELECT label, block, unnest(range(1, 17)) AS bin, x FROM p)
SELECT label AS machine, block, bin, len(x) AS points, round(2 * sqrt(pow(list_sum(list_transform(x, lambda v, i: v * cos(2 * pi() * bin * (i - 1) / len(x)))), 2) + pow(list_sum(list_transform(x, lambda v, i: v * sin(2 * pi() * bin * (i - 1) / len(x)))), 2)) / len(x), 6) + 0.0 AS amplitude FROM b""",
)
def long_spectrum(spark, sf_dir):
    """Transforms over blocks of 1,024 consecutive waveforms of a machine, 65,536 points; the last block has the
    largest power of two that its waveforms fill. Waveforms are numbered by stretches of ids.
    """
    rows = numbered(
        table(spark, sf_dir, "embeddings"), ["label"], [F.floor(F.col("vec_id") / 4096)], ["vec_id"], "k"
    ).withColumn("block", F.floor((F.col("k") - 1) / 1024))
    whole = F.flatten(
        F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda s: s["embedding"])
    )
    records = rows.groupBy("label", "block").agg(whole.alias("x")).select(
        "label",
        "block",
        F.slice("x", F.lit(1), F.pow(F.lit(2.0), F.floor(F.log2(F.size("x").cast("double")))).cast("int")).alias("x")
    )
    spectra = records.select(
        "label",
        "block",
        F.size("x").cast("long").alias("points"),
        F.posexplode(F.slice(dsp.rfft("x"), 2, 16)).alias("at", "a")
    )
    return spectra.select(
        F.col("label").alias("machine"),
        "block",
        (F.col("at") + 1).cast("long").alias("bin"),
        "points",
        tidy(F.col("a"), 6).alias("amplitude")
    )


@query(
    "model_registry",
    """WITH s AS (SELECT user_id, value > 120 AS y, value * 0.5 > 60 + user_id % 7 AS p1, value * 0.48 > 58 + user_id % 3 AS p2 FROM events), v AS (SELECT 1 AS version, y, p1 AS p FROM s UNION ALL SELECT 2, y, p2 FROM s),
f AS (SELECT version, round(2.0 * count(*) FILTER (WHERE y AND p) / nullif(2 * count(*) FILTER (WHERE y AND p) + count(*) FILTER (WHERE y <> p), 0), 6) AS f1 FROM v GROUP BY version)
SELECT version, f1, CASE WHEN version = 1 THEN CASE WHEN (SELECT f1 FROM f WHERE version = 2) >= f1 - 0.01 THEN 'retired' ELSE 'active' END ELSE CASE WHEN f1 >= (SELECT f1 FROM f WHERE version = 1) - 0.01 THEN 'active' ELSE 'rolled back' END END AS state FROM f""",
)
def model_registry(spark, sf_dir):
    """Versions with their scores; the new one becomes active unless it loses more than a hundredth, then it is rolled
    back.
    """
    rows = events(spark, sf_dir)
    y = F.col("value") > 120
    one = F.struct(F.lit(1).alias("version"), (F.col("value") * 0.5 > 60 + F.col("user_id") % 7).alias("p"))
    two = F.struct(F.lit(2).alias("version"), (F.col("value") * 0.48 > 58 + F.col("user_id") % 3).alias("p"))
    scored = rows.select(y.alias("y"), F.explode(F.array(one, two)).alias("v")).select("y", "v.*")
    hit = F.count_if(F.col("y") & F.col("p"))
    f1 = scored.groupBy("version").agg(
        F.round(2.0 * hit / F.nullif(2 * hit + F.count_if(F.col("y") != F.col("p")), F.lit(0)), 6).alias("f1")
    )
    # a row for each version
    both = f1.withColumn("all", F.collect_list(F.struct("version", "f1")).over(Window.partitionBy(F.lit(0))))
    of = lambda v: F.filter("all", lambda s: s["version"] == v)[0]["f1"]
    good = of(2) >= of(1) - 0.01
    state = F.when(
        F.col("version") == 1, F.when(good, "retired").otherwise("active")
    ).otherwise(F.when(good, "active").otherwise("rolled back"))
    return both.select("version", "f1", state.alias("state"))


@query("spectrum_udtf", SQL["rfft_spectrum"])
def spectrum_udtf(spark, sf_dir):
    """A table function that turns a spectrum into rows, joined laterally in SQL."""

    @F.udtf(returnType="bin: bigint, amplitude: double")
    class Bins:
        def eval(self, spectrum):
            for i, a in enumerate(spectrum or []):
                yield i, float(a)

    spark.udtf.register("spectrum_bins", Bins)
    spectra = table(spark, sf_dir, "embeddings").select("vec_id", dsp.rfft("embedding").alias("s"))
    rows = spark.sql("SELECT vec_id, b.bin, b.amplitude FROM {spectra}, LATERAL spectrum_bins(s) b", spectra=spectra)
    return rows.select("vec_id", "bin", tidy(F.col("amplitude"), 5).alias("amplitude"))


@query(
    "workorder_upsert",
    "SELECT o_orderkey AS wo_id, CASE WHEN o_orderkey % 10 = 0 THEN 'C' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 1 END AS version FROM orders",
)
def workorder_upsert(spark, sf_dir):
    """Work orders after a batch of changes: closed ones replace their older version."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("wo_id"), F.col("o_orderstatus").alias("status"), F.lit(1).alias("version")
    )
    changes = orders.where("wo_id % 10 = 0").select("wo_id", F.lit("C").alias("status"), F.lit(2).alias("version"))
    return io.upsert(orders, changes, ["wo_id"], ["version"]).select("wo_id", "status", "version")


@query(
    "transient_capture",
    """SELECT t.event_id AS trigger_id, count(*) AS rows, round(max(abs(e.value)), 6) AS peak FROM events t JOIN events e ON e.user_id = t.user_id AND abs(epoch_us(e.ts) - epoch_us(t.ts)) <= 21600000000 WHERE t.value > 300 GROUP BY t.event_id""",
)
def transient_capture(spark, sf_dir):
    """What a device sent within six hours around each trigger."""
    rows = events(spark, sf_dir).withColumn("us", F.unix_micros("ts"))
    triggers = rows.where("value > 300").select(
        "user_id", F.col("event_id").alias("trigger_id"), F.col("us").alias("t_us")
    )
    return interval(
        triggers, rows.select("user_id", "us", "value"), "user_id", "t_us", "us", 6 * 3600 * 1_000_000
    ).groupBy("trigger_id").agg(F.count("*").alias("rows"), F.round(F.max(F.abs("value")), 6).alias("peak"))


@query(
    "stream_battery",
    "SELECT user_id AS device_id, event_id, round(value / 5, 6) AS battery_pct FROM events WHERE event_type = 'signup' AND value / 5 < 15"
)
def stream_battery(spark, sf_dir):
    """Heartbeats with a low battery, as they come."""
    rows = jobs.event_stream(spark, sf_dir).where("event_type = 'signup'").select(
        F.col("user_id").alias("device_id"), "event_id", F.round(F.col("value") / 5, 6).alias("battery_pct")
    )
    return jobs.drained(rows.where("battery_pct < 15"))
