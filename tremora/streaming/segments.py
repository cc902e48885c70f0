"""A log of append-only segment files as a streaming source.

The log has partitions, each a folder of segments named by the byte at which they begin; a segment is a run of
fixed-size records. An offset is a byte position in every partition, so what a batch reads is fixed by its offsets and
reads the same after a restart, and a partition that grew while a batch ran is read on from where the batch ended.
Delivery is at least once: a producer that sends again appends again, and readers drop what they have seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tremora.sources.objects import locate, put

RECORD = np.dtype([("device_id", "<i8"), ("seq", "<i8"), ("us", "<i8"), ("value", "<f8"), ("channel", "S16")])
SCHEMA = "device_id long, seq long, us long, value double, channel string, log_partition int, log_offset long"
#: Records of one task's share of a batch.
SHARE = 1 << 20


def _ends(folder: str) -> dict[str, list[tuple[int, int, str]]]:
    """(start, end, path) of the segments of every partition, in order."""
    fs, path = locate(folder)
    found: dict[str, list[tuple[int, int, str]]] = {}
    for info in fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True)):
        if info.type == pafs.FileType.File and info.base_name.endswith(".seg") and not info.base_name.startswith("."):
            partition = info.path.split("/")[-2].removeprefix("partition=")
            start = int(info.base_name.removesuffix(".seg"))
            whole = info.size // RECORD.itemsize * RECORD.itemsize
            found.setdefault(partition, []).append((start, start + whole, info.path))
    return {p: sorted(segments) for p, segments in found.items()}


def append(rows: DataFrame, folder: str, partitions: int) -> None:
    """Append (device_id, seq, us, value, channel) to the log, a device always to the same partition; one producer at a
    time. Rows with a null are left out.

    A task gathers its partition's records into one new segment, which appears when it is whole. Records of one call
    that a failed and a repeated attempt both wrote stand under the same name, so only one of them stays.
    """
    ends = {p: segments[-1][1] for p, segments in _ends(folder).items()}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            records = np.zeros(batch.num_rows, dtype=RECORD)
            for name in RECORD.names[:-1]:
                records[name] = batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
            records["channel"] = [c.encode()[:16] for c in batch.column(4).to_pylist()]
            own = batch.column(5).to_numpy(zero_copy_only=False)
            for p in np.unique(own):
                held.setdefault(int(p), []).append(records[own == p])
        for p, parts in held.items():
            put(f"{folder}/partition={p}/{ends.get(str(p), 0):020d}.seg", np.concatenate(parts).tobytes())
        yield pa.record_batch([pa.array([sum(map(len, v)) for v in held.values()], pa.int64())], names=["n"])

    log = F.pmod(F.xxhash64("device_id"), F.lit(partitions)).cast("int").alias("p")
    whole = rows.select("device_id", "seq", "us", "value", "channel").dropna()
    dealt = whole.select("*", log).repartition(partitions, "p")
    dealt.sortWithinPartitions("p", "us", "seq").mapInArrow(write, "n long").agg(F.sum("n")).collect()


class _Share(InputPartition):
    def __init__(self, partition: int, path: str, base: int, start: int, end: int):
        super().__init__((partition, start, end))
        self.partition, self.path, self.base, self.start, self.end = partition, path, base, start, end


class SegmentReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = options["path"]

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {p: segments[-1][1] for p, segments in sorted(_ends(self.folder).items())}

    def partitions(self, start: dict, end: dict) -> list[_Share]:
        shares, step = [], SHARE * RECORD.itemsize
        for partition, segments in sorted(_ends(self.folder).items()):
            low, high = start.get(partition, 0), end.get(partition, 0)
            for base, stop, path in segments:
                a, b = max(base, low), min(stop, high)
                shares += [_Share(int(partition), path, base, x, min(x + step, b)) for x in range(a, b, step)]
        return shares

    def read(self, partition: _Share) -> Iterator[pa.RecordBatch]:
        fs, _ = locate(self.folder)
        with fs.open_input_file(partition.path) as f:
            data = f.read_at(partition.end - partition.start, partition.start - partition.base)
        records = np.frombuffer(data, dtype=RECORD)
        n = len(records)
        yield pa.record_batch(
            [
                *(pa.array(np.ascontiguousarray(records[name])) for name in RECORD.names[:-1]),
                pa.array([c.decode(errors="replace") for c in records["channel"].tolist()], pa.string()),
                pa.array(np.full(n, partition.partition), pa.int32()),
                pa.array(partition.start + RECORD.itemsize * np.arange(n), pa.int64())
            ],
            names=["device_id", "seq", "us", "value", "channel", "log_partition", "log_offset"]
        )

    def commit(self, end: dict) -> None:
        pass


class Segments(DataSource):
    """``spark.readStream.format("segments").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> SegmentReader:  # noqa: N802
        return SegmentReader(self.options)


def segment_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The log as a stream, with ``ts``."""
    spark.dataSource.register(Segments)
    return spark.readStream.format("segments").load(folder).withColumn("ts", F.timestamp_micros("us"))
