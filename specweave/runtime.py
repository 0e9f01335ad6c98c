"""Session helpers: the shared folder for tables that cut lineage."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no folder of its own, as in local tests.
LOCAL_FALLBACK = "file:/tmp/checkpoints"
#: Bytes of an Arrow batch to a Python worker.
BATCH_BYTES = 4 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which every executor can read; without it, one of this machine in local mode only."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    return (found or LOCAL_FALLBACK).rstrip("/")


def materialize(df: DataFrame, name: str = "table", counted: bool = False, observed: dict[str, Column] | None = None):
    """Write ``df`` as Parquet in the shared folder and return a scan of it.

    The scan has no lineage, so a lost executor costs one task and not the
    plan that made the table; it is written once and read as often as needed.
    The shuffle files behind it have then served and are deleted. With
    ``counted`` or ``observed`` aggregates the result is the scan and the
    number of rows or the aggregates' values, taken while writing.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    wanted = {"n": F.count(F.lit(1))} if counted else observed
    seen = Observation()
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.observe(seen, *[c.alias(k) for k, c in wanted.items()]) if wanted else df).write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.shared_path = path
    return (table, seen.get["n"] if counted else seen.get) if wanted else table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize``, once all that reads them has been written itself."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.shared_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """A function over Arrow batches that gives freed memory back to the system at its end; idle workers otherwise keep it."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            _trim()

    return tidied


def tidy_group(run):
    """The same for a function of one group, or of two; for groups that are large."""

    def of_one(table):
        out = run(table)
        _trim()
        return out

    def of_two(left, right):
        out = run(left, right)
        _trim()
        return out

    return of_one if run.__code__.co_argcount == 1 else of_two


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once a session, for Python workers.

    Arrow batches to them hold few MB from then on: by default they end at
    a number of rows, however long the texts in these are.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if not any(str(f).endswith("/specweave.zip") for f in context._jsc.sc().listFiles().mkString("\n").split("\n")):
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp()) / "specweave.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            for source in sorted(root.rglob("*.py")):
                archive.write(source, source.relative_to(root.parent))
        context.addPyFile(str(target))
    return spark
