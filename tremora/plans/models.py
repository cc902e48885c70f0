"""Evaluation, splits, drift, fusion and decisions around fault models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.functions import dsp
from tremora.functions.features import tidy
from tremora.operators.anomaly import scored
from tremora.operators.ranks import running
from tremora.plans.registry import events, query
from tremora.session import table


@query(
    "confusion_f1",
    """WITH t AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn FROM labels)
SELECT tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS "precision", round(tp / nullif(tp + fn, 0), 6) AS recall,
  round(((tp + fn) * coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + (tn + fp) * coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / (tp + fp + fn + tn), 6) AS weighted_f1,
  ((tp + fn) * coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + (tn + fp) * coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / (tp + fp + fn + tn) > 0.92 AS gate FROM t""",
)
def confusion_f1(spark, sf_dir):
    """Confusion counts, precision, recall, weighted F1 and the release gate."""
    c = lambda y, p: F.count_if((F.col("quality") == y) & (F.col("toxic") == p))
    t = table(spark, sf_dir, "labels").agg(
        c(1, 1).alias("tp"), c(0, 1).alias("fp"), c(1, 0).alias("fn"), c(0, 0).alias("tn")
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: a / F.nullif(b, F.lit(0))
    f1 = (
        (tp + fn) * F.coalesce(
            ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)
        ) + (tn + fp) * F.coalesce(ratio(2 * tn, 2 * tn + fp + fn), F.lit(0.0))
    ) / (tp + fp + fn + tn)
    return t.select(
        "tp",
        "fp",
        "fn",
        "tn",
        F.round(ratio(tp, tp + fp), 6).alias("precision"),
        F.round(ratio(tp, tp + fn), 6).alias("recall"),
        F.round(f1, 6).alias("weighted_f1"),
        (f1 > 0.92).alias("gate")
    )


@query(
    "auc_rank",
    """WITH r AS (SELECT quality, (rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0) AS r FROM labels JOIN documents USING (doc_id)),
s AS (SELECT sum(r) FILTER (WHERE quality = 1) AS s, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality = 0) AS n FROM r) SELECT round((s - p * (p + 1) / 2.0) / nullif(p * n, 0), 6) AS auc FROM s""",
)
def auc_rank(spark, sf_dir):
    """Area under the curve by rank sums: scores are counted first, and ranked in cells."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    levels = rows.groupBy("n_chars").agg(
        F.count_if(F.col("quality") == 1).alias("p"), F.count_if(F.col("quality") == 0).alias("n")
    )
    won = running(levels.withColumn("all", F.lit(0)), ["all"], "n_chars", "n").select(
        "p", "n", (F.col("p") * (F.col("__before") + F.col("n") / 2.0)).alias("w")
    ).agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return won.select(F.round(F.col("w") / F.nullif(F.col("p") * F.col("n"), F.lit(0)), 6).alias("auc"))


@query(
    "fpr_30d",
    "SELECT user_id AS asset_id, strftime(time_bucket(INTERVAL 30 DAYS, ts, TIMESTAMP '2024-01-01'), '%Y-%m-%d') AS period, round(count(*) FILTER (WHERE event_type = 'error' AND value < 50) * 1.0 / nullif(count(*) FILTER (WHERE event_type = 'error'), 0), 6) AS fpr FROM events GROUP BY ALL"
)
def fpr_30d(spark, sf_dir):
    """Share of alarms that were false, by asset and 30 days."""
    w = F.window("ts", "30 days", "30 days", f"{(19723 % 30)} days")
    alarm = F.col("event_type") == "error"
    rate = F.count_if(alarm & (F.col("value") < 50)) / F.nullif(F.count_if(alarm), F.lit(0))
    return events(spark, sf_dir).groupBy(
        F.col("user_id").alias("asset_id"), w.alias("w")
    ).agg(F.round(rate, 6).alias("fpr")).select(
        "asset_id", F.date_format("w.start", "yyyy-MM-dd").alias("period"), "fpr"
    )


def _canary():
    return F.conv(F.substring(F.md5(F.col("user_id").cast("string")), 1, 8), 16, 10).cast("long") % 10 == 0


@query(
    "canary_bucket",
    "SELECT CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 = 0 AS canary, count(DISTINCT user_id) AS devices, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1"
)
def canary_bucket(spark, sf_dir):
    """A tenth of the devices on the new version, by a hash of their names: neighbouring numbers don't share a fate."""
    return events(spark, sf_dir).groupBy(_canary().alias("canary")).agg(
        F.countDistinct("user_id").alias("devices"), F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")
    )


@query(
    "canary_monitor_48h",
    """SELECT CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 = 0 AS canary, count(*) FILTER (WHERE event_type = 'error') AS alarms, round(count(*) FILTER (WHERE event_type = 'error' AND value < 50) * 1.0 / nullif(count(*) FILTER (WHERE event_type = 'error'), 0), 6) AS fpr
FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1""",
)
def canary_monitor_48h(spark, sf_dir):
    """False alarms of both versions within 48 hours of the rollout."""
    rows = table(spark, sf_dir, "events").where("ts >= timestamp_ntz'2024-01-10' and ts < timestamp_ntz'2024-01-12'")
    alarm = F.col("event_type") == "error"
    return rows.groupBy(_canary().alias("canary")).agg(
        F.count_if(alarm).alias("alarms"),
        F.round(F.count_if(alarm & (F.col("value") < 50)) / F.nullif(F.count_if(alarm), F.lit(0)), 6).alias("fpr")
    )


@query(
    "psi_drift",
    """WITH b AS (SELECT event_type, ts >= TIMESTAMP '2024-01-16' AS late, least(floor(value / 50), 9) AS b, count(*) AS n FROM events GROUP BY ALL),
p AS (SELECT event_type, b, coalesce(sum(n) FILTER (WHERE late), 0) + 0.5 AS q, coalesce(sum(n) FILTER (WHERE NOT late), 0) + 0.5 AS r FROM b GROUP BY ALL), s AS (SELECT *, sum(q) OVER (PARTITION BY event_type) AS tq, sum(r) OVER (PARTITION BY event_type) AS tr FROM p)
SELECT event_type AS channel, round(sum((q / tq - r / tr) * ln((q / tq) / (r / tr))), 6) AS psi FROM s GROUP BY event_type""",
)
def psi_drift(spark, sf_dir):
    """Population stability between halves of the month, on fixed bins."""
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
    bins = events(spark, sf_dir).groupBy("event_type", F.least(F.floor(F.col("value") / 50), F.lit(9)).alias("b")).agg(
        (F.count_if(late) + 0.5).alias("q"), (F.count_if(~late) + 0.5).alias("r")
    )
    w = Window.partitionBy("event_type")
    shares = bins.select(
        "event_type", (F.col("q") / F.sum("q").over(w)).alias("q"), (F.col("r") / F.sum("r").over(w)).alias("r")
    )
    return shares.groupBy(F.col("event_type").alias("channel")).agg(
        F.round(F.sum((F.col("q") - F.col("r")) * F.ln(F.col("q") / F.col("r"))), 6).alias("psi")
    )


@query(
    "late_fusion_missing",
    """WITH m AS (SELECT user_id, avg(value) FILTER (WHERE event_type = 'view') AS a, avg(value) FILTER (WHERE event_type = 'click' AND user_id % 3 <> 0) AS b, avg(value) FILTER (WHERE event_type = 'error') AS c FROM events GROUP BY user_id)
SELECT user_id AS asset_id, round((coalesce(a * 0.5, 0) + coalesce(b * 0.3, 0) + coalesce(c * 0.2, 0)) / nullif(CASE WHEN a IS NULL THEN 0 ELSE 0.5 END + CASE WHEN b IS NULL THEN 0 ELSE 0.3 END + CASE WHEN c IS NULL THEN 0 ELSE 0.2 END, 0), 6) AS fused FROM m""",
)
def late_fusion_missing(spark, sf_dir):
    """Weighted mean over the modalities that are present."""
    weights = {"view": 0.5, "click": 0.3, "error": 0.2}
    present = {"click": F.col("user_id") % 3 != 0}
    scores = events(spark, sf_dir).groupBy("user_id").agg(
        *(
            F.avg(F.when((F.col("event_type") == k) & present.get(k, F.lit(True)), F.col("value"))).alias(k)
            for k in weights
        )
    )
    top = sum((F.coalesce(F.col(k) * w, F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
    weight = sum((F.when(F.col(k).isNull(), 0.0).otherwise(w) for k, w in weights.items()), F.lit(0.0))
    return scores.select(
        F.col("user_id").alias("asset_id"), F.round(top / F.nullif(weight, F.lit(0.0)), 6).alias("fused")
    )


@query(
    "severity_stage",
    """WITH d AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, max(value) AS v FROM events GROUP BY ALL) SELECT user_id AS asset_id, day, CASE WHEN v >= 300 THEN 4 WHEN v >= 200 THEN 3 WHEN v >= 100 THEN 2 ELSE 1 END AS stage FROM d""",
)
def severity_stage(spark, sf_dir):
    v = F.col("v")
    days = events(spark, sf_dir).groupBy(
        F.col("user_id").alias("asset_id"), F.date_format("ts", "yyyy-MM-dd").alias("day")
    ).agg(F.max("value").alias("v"))
    return days.select(
        "asset_id", "day", F.when(v >= 300, 4).when(v >= 200, 3).when(v >= 100, 2).otherwise(1).alias("stage")
    )


@query(
    "rul_linear",
    """WITH d AS (SELECT user_id, epoch(ts) / 86400 - 19723 AS d, value FROM events), f AS (SELECT user_id, regr_slope(value, d) AS s, regr_intercept(value, d) AS i, max(d) AS now FROM d GROUP BY user_id)
SELECT user_id AS asset_id, CASE WHEN round(s, 6) > 0 THEN round((600 - i) / s - now, 4) END AS rul_days, NOT coalesce(round(s, 6) > 0, false) AS abstained FROM f""",
)
def rul_linear(spark, sf_dir):
    """Days until the trend reaches the limit; no answer where it doesn't rise."""
    day = F.unix_micros("ts") / 86_400e6 - 19723
    rows = events(spark, sf_dir).withColumn("d", day).groupBy(F.col("user_id").alias("asset_id"))
    f = rows.agg(
        F.regr_slope("value", "d").alias("s"), F.regr_intercept("value", "d").alias("i"), F.max("d").alias("now")
    )
    rising = F.coalesce(F.round("s", 6) > 0, F.lit(False))
    return f.select(
        "asset_id",
        F.when(rising, F.round((600 - F.col("i")) / F.col("s") - F.col("now"), 4)).alias("rul_days"),
        (~rising).alias("abstained")
    )


@query(
    "attribution_linear",
    """WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings), m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc FROM e)
SELECT vec_id, round(0.5 * (a - ma), 6) + 0.0 AS f1, round(-0.2 * (b - mb), 6) + 0.0 AS f2, round(0.3 * (c - mc), 6) + 0.0 AS f3 FROM e, m""",
)
def attribution_linear(spark, sf_dir):
    """Exact attributions of a linear score: weight times deviation from the mean."""
    weights = {"f1": (0, 0.5), "f2": (1, -0.2), "f3": (2, 0.3)}
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", *(F.col("embedding")[i].cast("double").alias(n) for n, (i, _) in weights.items())
    )
    means = rows.agg(*(F.avg(n).alias(f"mean_{n}") for n in weights)).withColumn("one", F.lit(1))
    centred = rows.withColumn("one", F.lit(1)).join(F.broadcast(means), "one")  # one row
    return centred.select(
        "vec_id", *(tidy(F.lit(w) * (F.col(n) - F.col(f"mean_{n}"))).alias(n) for n, (_, w) in weights.items())
    )


@query(
    "grouped_split",
    "SELECT CASE WHEN label % 5 = 0 THEN 'test' WHEN label % 5 = 1 THEN 'validation' ELSE 'train' END AS part, count(DISTINCT label) AS bearings, count(*) AS windows FROM embeddings GROUP BY 1"
)
def grouped_split(spark, sf_dir):
    """A split by bearing: no bearing stands on both sides."""
    k = F.col("label") % 5
    part = F.when(k == 0, "test").when(k == 1, "validation").otherwise("train")
    return table(spark, sf_dir, "embeddings").groupBy(part.alias("part")).agg(
        F.countDistinct("label").alias("bearings"), F.count("*").alias("windows")
    )


@query(
    "leakage_audit",
    "SELECT CAST(count(*) AS BIGINT) AS shared FROM (SELECT label FROM embeddings WHERE vec_id % 4 = 0 INTERSECT SELECT label FROM embeddings WHERE vec_id % 4 <> 0)"
)
def leakage_audit(spark, sf_dir):
    """Bearings on both sides of a split by window."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.where("vec_id % 4 = 0").select("label").intersect(
        rows.where("vec_id % 4 <> 0").select("label")
    ).agg(F.count("*").alias("shared"))


@query(
    "retrain_trigger",
    "SELECT source, count(*) AS labels, count(*) > 20 AS retrain FROM labels JOIN documents USING (doc_id) GROUP BY source"
)
def retrain_trigger(spark, sf_dir):
    n = F.count("*")
    return table(spark, sf_dir, "labels").join(
        table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id"
    ).groupBy("source").agg(n.alias("labels"), (n > 20).alias("retrain"))


@query(
    "operating_point_thresholds",
    """SELECT event_type AS operating_point, count(*) AS n, CASE WHEN any_value(t.t) IS NULL THEN 'refused' ELSE 'scored' END AS verdict, count(*) FILTER (WHERE value > t.t) AS alarms
FROM events LEFT JOIN (VALUES ('view', 200.0), ('click', 180.0), ('error', 150.0)) t(p, t) ON event_type = t.p GROUP BY event_type""",
)
def operating_point_thresholds(spark, sf_dir):
    """Thresholds calibrated for each operating point; without one the verdict is refused, not a default."""
    limits = spark.createDataFrame([("view", 200.0), ("click", 180.0), ("error", 150.0)], "event_type string, t double")
    rows = events(spark, sf_dir).join(limits, "event_type", "left")
    return rows.groupBy(F.col("event_type").alias("operating_point")).agg(
        F.count("*").alias("n"),
        F.when(F.max("t").isNull(), "refused").otherwise("scored").alias("verdict"),
        F.count_if(F.col("value") > F.col("t")).alias("alarms")
    )


@query(
    "federated_mean",
    "SELECT round(sum(m * n) / sum(n), 6) AS mean, CAST(sum(n) AS BIGINT) AS n FROM (SELECT user_id, avg(value) AS m, count(*) AS n FROM events GROUP BY user_id)"
)
def federated_mean(spark, sf_dir):
    """Weighted mean of the sites' own means."""
    sites = events(spark, sf_dir).groupBy("user_id").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    return sites.agg(F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 6).alias("mean"), F.sum("n").alias("n"))


@query(
    "confidence_gate",
    """WITH e AS (SELECT vec_id, embedding[1:12] AS c FROM embeddings) SELECT vec_id, CASE WHEN list_max(c) >= 0.2 THEN list_position(c, list_max(c)) - 1 END AS fault_class FROM e""",
)
def confidence_gate(spark, sf_dir):
    """The class of largest confidence, or none below the gate."""
    c = F.slice("embedding", 1, 12)
    return table(spark, sf_dir, "embeddings").select("vec_id", c.alias("c")).select(
        "vec_id",
        F.when(F.array_max("c") >= 0.2, (F.array_position("c", F.array_max("c")) - 1).cast("int")).alias("fault_class")
    )


@query("pca_residual")
def pca_residual(spark, sf_dir):
    """Reconstruction residual of each waveform outside the first components: a linear stand-in for an autoencoder's
    score.
    """
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null").select(
        "vec_id", dsp.doubles(F.col("embedding")).alias("x")
    )

    def partial(batches):
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                x = np.hstack([x, np.ones((len(x), 1))])
                total, n = (0 if total is None else total) + x.T @ x, n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"]
            )

    # second moments: a fixed number of sums, whatever the number of rows
    parts = rows.select("x").mapInArrow(partial, "i long, v array<double>")
    sums = parts.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    if sums.empty:
        return rows.select("vec_id", F.lit(None).cast("double").alias("residual")).limit(0)
    size = int(sums["i"].max()) + 1
    gram = np.zeros((size, size))
    gram[sums["i"], sums["j"]] = sums["v"]
    n = gram[-1, -1]
    mean = gram[-1, :-1] / n
    basis = np.linalg.eigh(gram[:-1, :-1] / n - np.outer(mean, mean))[1][:, -8:]

    @F.arrow_udf(T.DoubleType())
    def residual(column: pa.Array) -> pa.Array:
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) - mean
        return pa.array(np.linalg.norm(x - x @ basis @ basis.T, axis=1))

    return rows.select("vec_id", F.round(residual("x"), 6).alias("residual"))


@query("machine_anomaly")
def machine_anomaly(spark, sf_dir):
    """Distance of each waveform's features from its machine's history, and its percentile there."""
    x = F.col("x")
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null").select(
        "vec_id", "label", dsp.doubles(F.col("embedding")).alias("x"), dsp.rfft("embedding").alias("s")
    )
    features = F.array(dsp.array_rms(x), dsp.array_peak(x), *(F.col("s")[k] for k in range(1, 7)))
    found = scored(rows.select("vec_id", "label", features.alias("f")), "label", "vec_id", "f")
    return found.select(
        F.col("key").alias("vec_id"), "machine", "score", F.round("percentile", 6).alias("percentile")
    )
