"""Session settings the package relies on, and the shared working folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}
_SCRATCH = threading.local()


def configure(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings results depend on.

    UTC, last-wins duplicate JSON keys, and Parquet timestamps with statistics, which
    the default INT96 form lacks and time filters need to skip row groups.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
_WRITERS_USED = threading.RLock()
_writers_of: dict[int, tuple[str, int]] = {}


@contextmanager
def open_writers(spark: SparkSession, files: int) -> Iterator[None]:
    """A task that writes into a few folders keeps so many files open, instead of sorting its rows.

    Rows that go into more folders are still sorted, so others writing meanwhile lose nothing.
    """
    session = spark._jsparkSession.hashCode()
    with _WRITERS_USED:
        before, users = _writers_of.get(session, (spark.conf.get(_WRITERS), 0))
        _writers_of[session] = before, users + 1
        spark.conf.set(_WRITERS, str(max(files + 1, int(before))))  # Spark sorts once there are as many
    try:
        yield
    finally:
        with _WRITERS_USED:
            before, users = _writers_of.pop(session)
            if users > 1:
                _writers_of[session] = before, users - 1
            else:
                spark.conf.set(_WRITERS, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master falls back to a temporary folder; on a cluster an unset
    folder is an error because executors would not see a driver-local path.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="loamlog-")
    return _LOCAL_FOLDERS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def scratch_table(frame: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: no lineage, nothing to recompute.

    The files stay until ``release`` or ``clear_scratch``, or the end of an enclosing
    ``temporary_scratch``.
    """
    path = scratch_path(frame.sparkSession, label)
    frame.write.parquet(path)
    _created().append(path)
    found = frame.sparkSession.read.schema(frame.schema).parquet(path)
    found.scratch = path
    return found


def release(table: DataFrame) -> None:
    """Delete the files of one scratch table that nothing reads any more."""
    _delete(table.sparkSession, table.scratch)
    if table.scratch in _created():
        _created().remove(table.scratch)


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def _created() -> list[str]:
    if not hasattr(_SCRATCH, "paths"):
        _SCRATCH.paths = []
    return _SCRATCH.paths


def clear_scratch(spark: SparkSession, keep: int = 0) -> None:
    """Delete this thread's scratch tables; frames that read them are of no use afterwards."""
    for path in _created()[keep:]:
        _delete(spark, path)
    del _created()[keep:]


@contextmanager
def temporary_scratch(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are deleted at the end, when their results have been used."""
    keep = len(_created())
    try:
        yield
    finally:
        clear_scratch(spark, keep)
