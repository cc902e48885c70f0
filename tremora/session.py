"""Session helpers: settings, table readers, package shipping and durable cuts of lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tremora", master: str = "local[8]", **conf: str) -> SparkSession:
    """A session for tests and benchmarks. A cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Set by the cluster; only a local session without one gets a
    temporary one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = jsc.get() if jsc.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tremora-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in this driver's folder of the shared one. The folder goes when the driver's JVM ends, since frames
    that were given out may read it until then.
    """
    folder = shared_dir(spark).rstrip("/")
    if folder not in _own:
        _own[folder] = f"{folder}/tremora-{uuid.uuid4().hex}"
        place = spark._jvm.org.apache.hadoop.fs.Path(_own[folder])
        fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(place)
        fs.deleteOnExit(place)
    return f"{_own[folder]}/{name}-{uuid.uuid4().hex}"


def cut(frame: DataFrame, name: str = "cut") -> DataFrame:
    """Compute once, into a table in the shared folder: later readers survive the loss of any executor."""
    path = scratch(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def forget(frame: DataFrame) -> None:
    """Delete the tables that ``cut`` wrote for a frame that is read no more."""
    spark = frame.sparkSession
    folder = _own.get(shared_dir(spark).rstrip("/"), "/")
    for file in frame.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if path.getParent().toUri().getPath() == spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath():
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of rows that Spark hands to a Python worker at once. Texts vary from words to books, so rows say little.
ARROW_BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers however the driver found it, and bound their batches by bytes
    unless the user has.
    """
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(ARROW_BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_tremora_shipped", False):
        return
    root = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="tremora-py-"), "tremora_pkg.zip")
    with zipfile.ZipFile(out, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(out)
    context._tremora_shipped = True
