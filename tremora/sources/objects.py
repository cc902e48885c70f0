"""Waveform objects with byte ranges: large files of samples, an index beside each, and a data source that reads only
the ranges it is asked for.

A task writes the waveforms of one machine as one object, little-endian 32-bit samples one after the other, and an
index of (key, offset, samples). What the tasks wrote is listed in a table of files by machine, so files of attempts
that were lost are never read. Reading starts from that table: filters on machine and key are pushed down to it, each
file that is left is one partition, and a task reads the index of its file and then, by offset, the samples ``first``
to ``last`` of each waveform.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual
)

#: Bytes of samples after which an object is closed.
OBJECT_BYTES = 64 << 20
#: Ranges that lie closer together than this are read as one.
GAP_BYTES = 4 << 10
SCHEMA = "machine int, key long, samples array<float>, bytes_read long"


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder of Spark's, as tasks open it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def put(uri: str, data: bytes) -> None:
    """Write a file that appears under its name only when it is whole."""
    fs, path = locate(uri)
    folder, _, name = path.rpartition("/")
    fs.create_dir(folder, recursive=True)
    half = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(half) as out:
        out.write(data)
    fs.move(half, path)


class _Object:
    """One object that grows, with its index."""

    def __init__(self, folder: str, machine: int):
        self.folder, self.machine, self.name = folder, machine, uuid.uuid4().hex
        self.parts: list[bytes] = []
        self.keys: list[int] = []
        self.counts: list[int] = []
        self.size = 0

    def add(self, key: int, samples: np.ndarray) -> None:
        self.parts.append(samples.astype("<f4").tobytes())
        self.keys.append(key)
        self.counts.append(len(samples))
        self.size += 4 * len(samples)

    def close(self) -> tuple[int, int, int, str]:
        place = f"{self.folder}/machine={self.machine}/{self.name}"
        put(f"{place}.bin", b"".join(self.parts))
        counts = np.array(self.counts, dtype=np.int64)
        index = pa.table({"key": self.keys, "offset": 4 * (np.cumsum(counts) - counts), "samples": counts})
        out = pa.BufferOutputStream()
        pq.write_table(index, out)
        put(f"{place}.idx", out.getvalue().to_pybytes())
        return self.machine, min(self.keys), max(self.keys), place


def write_objects(waves: DataFrame, folder: str) -> None:
    """Store (machine, key, samples); rows with a null among them are left out."""
    rows = waves.select("machine", "key", "samples").where(
        "machine is not null and key is not null and samples is not null"
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Object | None = None
        done = []
        for batch in batches:
            for i, (machine, key) in enumerate(
                zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            ):
                if now and (now.machine != machine or now.size >= OBJECT_BYTES):
                    done.append(now.close())
                    now = None
                now = now or _Object(folder, machine)
                now.add(key, batch.column(2)[i].values.to_numpy(zero_copy_only=False))
        if now:
            done.append(now.close())
        yield pa.record_batch(
            [
                pa.array([d[0] for d in done], pa.int32()),
                pa.array([d[1] for d in done], pa.int64()),
                pa.array([d[2] for d in done], pa.int64()),
                pa.array([d[3] for d in done], pa.string())
            ],
            names=["machine", "low", "high", "place"]
        )

    dealt = rows.repartitionByRange("machine", "key").sortWithinPartitions("machine", "key")
    files = dealt.mapInArrow(write, "machine int, low long, high long, place string")
    files.write.partitionBy("machine").parquet(f"{folder}/_files")


class _File(InputPartition):
    def __init__(self, machine: int, place: str):
        super().__init__(place)
        self.machine, self.place = machine, place


class RangeReader(DataSourceReader):
    """Reads samples ``first`` to ``last`` (from 0, exclusive) of the waveforms that the filters leave."""

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.first, self.last = int(options.get("first", 0)), int(options.get("last", 1 << 40))
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        signs = {
            EqualTo: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="
        }
        for f in filters:
            column = getattr(f, "attribute", None)
            if isinstance(f, IsNotNull) and column in (("machine",), ("key",)):
                continue  # neither is ever null
            if type(f) in signs and column in (("machine",), ("key",)):
                self.filters.append((column[0], signs[type(f)], f.value))
            else:
                yield f

    def _where(self, machine, low, high):
        """An expression on the files' (or, with low = high = key, the waveforms') bounds."""
        test = pads.scalar(True)
        for name, sign, value in self.filters:
            values = list(value) if sign == "in" else [value]
            if name == "machine":
                each = [
                    {"=": machine == v, "in": machine == v, ">": machine > v, ">=": machine >= v, "<": machine < v, "<=": machine <= v}[sign]
                    for v in values
                ]
            else:
                inside = lambda v: (low <= v) & (high >= v)
                each = [
                    {"=": inside(v), "in": inside(v), ">": high > v, ">=": high >= v, "<": low < v, "<=": low <= v}[sign]
                    for v in values
                ]
            any_of = pads.scalar(False)
            for e in each:
                any_of = any_of | e
            test = test & any_of
        return test

    def partitions(self) -> list[_File]:
        fs, path = locate(f"{self.folder}/_files")
        schema = pa.schema([("low", pa.int64()), ("high", pa.int64()), ("place", pa.string()), ("machine", pa.int32())])
        files = pads.dataset(
            path,
            schema=schema,
            filesystem=fs,
            format="parquet",
            partitioning=pads.partitioning(pa.schema([("machine", pa.int32())]), flavor="hive"),
            exclude_invalid_files=False
        )
        left = files.to_table(
            columns=["machine", "place"], filter=self._where(pads.field("machine"), pads.field("low"), pads.field("high"))
        )
        return [_File(r["machine"], r["place"]) for r in left.to_pylist()]

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file is left
            return
        fs, path = locate(partition.place)
        index_bytes = fs.get_file_info(f"{path}.idx").size
        with fs.open_input_file(f"{path}.idx") as f:
            index = pq.read_table(f)
        key = pads.field("key")
        own = pads.dataset(index).to_table(filter=self._where(pads.scalar(partition.machine), key, key))
        first = np.minimum(own["samples"].to_numpy(), self.first)
        count = np.maximum(np.minimum(own["samples"].to_numpy(), self.last) - first, 0)
        start = own["offset"].to_numpy() + 4 * first
        found, read = [], np.zeros(len(start), dtype=np.int64)
        with fs.open_input_file(f"{path}.bin") as f:
            i = 0
            while i < len(start):
                j, end = i, start[i] + 4 * count[i]
                while j + 1 < len(start) and start[j + 1] - end <= GAP_BYTES:
                    j += 1
                    end = max(end, start[j] + 4 * count[j])
                data = f.read_at(int(end - start[i]), int(start[i]))
                read[i] = len(data)
                for k in range(i, j + 1):
                    at = int(start[k] - start[i])
                    found.append(np.frombuffer(data, dtype="<f4", count=int(count[k]), offset=at))
                i = j + 1
        if len(start):
            read[0] += index_bytes
        yield pa.record_batch(
            [
                pa.array(np.full(len(start), partition.machine), pa.int32()),
                own["key"].combine_chunks(),
                pa.array(found, pa.list_(pa.float32())),
                pa.array(read)
            ],
            names=["machine", "key", "samples", "bytes_read"]
        )


class WaveformRanges(DataSource):
    """``spark.read.format("waveform_ranges").option("first", 16).option("last", 32).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "waveform_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options)


def waveform_ranges(spark: SparkSession, folder: str, first: int = 0, last: int | None = None) -> DataFrame:
    """(machine, key, samples, bytes_read) of stored objects; filters on machine and key decide what is opened."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WaveformRanges)
    reader = spark.read.format("waveform_ranges").option("first", first)
    if last is not None:
        reader = reader.option("last", last)
    return reader.load(folder)


def stored(spark: SparkSession, source: str, waves: DataFrame) -> str:
    """The folder of a table's objects, imported once a session."""
    from tremora.session import scratch

    known = spark.__dict__.setdefault("_tremora_objects", {})
    if source not in known:
        folder = scratch(spark, "objects")
        write_objects(waves, folder)
        known[source] = folder
    return known[source]
