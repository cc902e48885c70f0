"""Payload decoding, waveform objects, routed and tiered sinks."""

from __future__ import annotations

import secrets
import struct
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.session import cut, scratch
from tremora.sources.objects import put

TELEMETRY = T.StructType(
    [
        T.StructField(n, t) for n, t in (
            ("device_id", T.StringType()),
            ("ts", T.TimestampType()),
            ("seq", T.LongType()),
            ("channel", T.StringType()),
            ("value", T.DoubleType()),
            ("rpm", T.DoubleType()),
            ("_corrupt", T.StringType())
        )
    ]
)


def parse_telemetry(raw: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Parsed rows and the quarantine of malformed payloads."""
    parsed = raw.withColumn(
        "__p", F.from_json(payload, TELEMETRY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    )
    bad = F.col("__p").isNull() | F.col("__p._corrupt").isNotNull()
    return parsed.where(~bad).select("__p.*").drop("_corrupt"), parsed.where(bad).select(payload)


def _cbor(data: bytes, at: int = 0):
    """(value, next position) of one CBOR item: integers, floats, strings, arrays, maps, simple values."""
    kind, low, at = data[at] >> 5, data[at] & 31, at + 1
    if kind == 7:
        if low in (20, 21, 22, 23):
            return (False, True, None, None)[low - 20], at
        size, form = {25: (2, ">e"), 26: (4, ">f"), 27: (8, ">d")}[low]
        return struct.unpack(form, data[at : at + size])[0], at + size
    if low >= 24:
        size = 1 << (low - 24)
        low, at = int.from_bytes(data[at : at + size], "big"), at + size
    if kind == 0:
        return low, at
    if kind == 1:
        return -1 - low, at
    if kind in (2, 3):
        raw = data[at : at + low]
        return (raw.decode() if kind == 3 else raw), at + low
    if kind == 4:
        out = []
        for _ in range(low):
            item, at = _cbor(data, at)
            out.append(item)
        return out, at
    if kind == 5:
        found = {}
        for _ in range(low):
            key, at = _cbor(data, at)
            found[key], at = _cbor(data, at)
        return found, at
    return _cbor(data, at)  # a tag: its item


@F.arrow_udf(T.MapType(T.StringType(), T.DoubleType()))
def cbor_numbers(column: pa.Array) -> pa.Array:
    """Numeric fields of CBOR maps; null for what isn't a map or doesn't parse."""
    out = []
    for raw in column.to_pylist():
        try:
            value = _cbor(raw)[0] if raw else None
        except (IndexError, KeyError, struct.error, UnicodeDecodeError):
            value = None
        out.append(
            [(str(k), float(v)) for k, v in value.items() if isinstance(v, (int, float)) and not isinstance(v, bool)]
            if isinstance(value, dict)
            else None
        )
    return pa.array(out, pa.map_(pa.string(), pa.float64()))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def float32_samples(column: pa.Array) -> pa.Array:
    """Little-endian 32-bit samples of binary captures; a trailing partial sample is dropped."""
    return pa.array(
        [None if raw is None else np.frombuffer(raw[: len(raw) // 4 * 4], dtype="<f4") for raw in column.to_pylist()],
        pa.list_(pa.float32())
    )


def waveforms(spark: SparkSession, folder: str) -> DataFrame:
    """Captures under {device}/{timestamp}/{axis}_axis.bin."""
    files = spark.read.format("binaryFile").option(
        "recursiveFileLookup", "true"
    ).option("pathGlobFilter", "*.bin").load(folder)
    pattern = r"([^/]+)/([^/]+)/([xyz])_axis\.bin$"
    return files.select(
        F.regexp_extract("path", pattern, 1).alias("device_id"),
        F.regexp_extract("path", pattern, 2).alias("ts"),
        F.regexp_extract("path", pattern, 3).alias("axis"),
        float32_samples("content").alias("samples")
    )


def write_metrics(rows: DataFrame, folder: str, ts: str = "ts") -> None:
    """Metric rows partitioned by channel and date, so that ranges and retention prune partitions."""
    rows.withColumn(
        "date", F.to_date(ts)
    ).repartition("channel", "date").write.mode("append").partitionBy("channel", "date").parquet(folder)


def route_alerts(alerts: DataFrame, folder: str) -> None:
    """One partition for each destination of severity routing."""
    from tremora.operators.alerts import route

    alerts.withColumn("channel", route(F.col("severity"))).write.mode("append").partitionBy("channel").parquet(folder)


def tier(age_days):
    """Storage tier of an age."""
    return F.when(age_days <= 30, "hot").when(age_days <= 365, "cold").when(
        age_days <= 7 * 365, "archive"
    ).otherwise("expired")


def csv_rows(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of CSV files with a header under a declared schema."""
    read = spark.read.option("header", True).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_broken"
    ).schema(f"{schema}, _broken string").csv(path)
    return read.where("_broken is null").drop("_broken"), read.where("_broken is not null")


def upsert(
    current: DataFrame, changes: DataFrame, keys: list[str], version: list[str], summed: dict | None = None
) -> DataFrame:
    """One row for each key: the one of the latest version; columns in ``summed`` are combined over both. One shuffle
    by key.
    """
    summed = summed or {}
    rest = [c for c in current.columns if c not in keys and c not in summed]
    newest = F.max_by(F.struct(*rest), F.struct(*version)).alias("__row")
    merged = current.unionByName(changes).groupBy(*keys).agg(newest, *(f(c).alias(c) for c, f in summed.items()))
    return merged.select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest), *summed)


def merge_days(
    spark: SparkSession, path: str, schema: str, changes: DataFrame, keys: list[str], summed: dict
) -> DataFrame:
    """Add ``changes`` to a table partitioned by ``day`` and return the table. Days without changes are not read; the
    others are put together aside and then replaced.
    """
    changes = cut(changes, "late")
    days = changes.select(F.col("day").alias("__day")).distinct()
    now = spark.read.schema(schema).parquet(path)
    touched = now.join(days, F.col("day") == F.col("__day"), "left_semi")
    merged = touched.unionByName(changes).groupBy(*keys).agg(*(f(c).alias(c) for c, f in summed.items()))
    cut(merged, "merged").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    return spark.read.schema(schema).parquet(path)


def deployment_key(spark: SparkSession) -> DataFrame:
    """One row with ``key``, the 32 bytes of the file that spark.tremora.key.path names (64 hex digits). A session
    without the setting, on any cluster, draws a key of its own into the shared folder; what it seals is opened in that
    session only, so a deployment that keeps sealed rows names its file.
    """
    path = spark.conf.get("spark.tremora.key.path", None)
    if not path:
        path = scratch(spark, "key")
        put(path, secrets.token_hex(32).encode())
    return spark.read.text(path).select(F.unhex("value").alias("key")).limit(1)


def tenant_rows(rows: DataFrame, allowed: DataFrame, key: str, tenant: str) -> DataFrame:
    """The rows whose tenant is among the allowed ones."""
    return rows.join(
        allowed.select(F.col(tenant).alias("__tenant")).distinct(), F.col(key) == F.col("__tenant"), "left_semi"
    )


def without_subjects(rows: DataFrame, subjects: DataFrame, key: str, path: str) -> DataFrame:
    """Write a table again without some subjects and read it; the caller swaps the paths and deletes the old one."""
    gone = subjects.select(F.col(key).alias("__gone"))
    rows.join(gone, F.col(key) == F.col("__gone"), "left_anti").write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def drop_partitions(spark: SparkSession, path: str, column: str, days: int) -> None:
    """Delete the folders column=date of a table that are ``days`` or more before the last one."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {
        s.getPath().getName().partition("=")[2]: s.getPath()
        for s in fs.listStatus(root) if s.getPath().getName().startswith(f"{column}=")
    }
    known = {date.fromisoformat(d): p for d, p in found.items() if d != "__HIVE_DEFAULT_PARTITION__"}
    for day, place in known.items():
        if day <= max(known) - timedelta(days=days):
            fs.delete(place, True)
