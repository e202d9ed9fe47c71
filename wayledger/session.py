"""Session settings, the shared folder, cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # HMAC key pads are plan literals: keep them out of printed plans.
    "spark.sql.redaction.string.regex": r"(?i)(X'[0-9A-F]{128}'|0x[0-9A-F]{128}|\[(?:[0-9A-F]{2} ){63}[0-9A-F]{2}\])",
}


_SCRATCH: list[str] = []


def build_session(app: str = "wayledger", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this library's settings; ``master`` only for local use."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def file_system(spark: SparkSession, path: str):
    """``(Hadoop file system, Hadoop path)`` of a folder in any store."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder.

    The folder is the setting ``spark.checkpoint.dir``, else the context's checkpoint folder. Where
    the cluster names none, only a session within one machine may go on, with a folder of its own:
    executors elsewhere would not see it. The new folder is deleted when the driver ends, or before
    by :func:`drop_scratch`, so copies of personal data do not outlive the session.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/wayledger-{uuid.uuid4().hex}"
    system, target = file_system(spark, path)
    system.mkdirs(target)
    system.deleteOnExit(target)
    _SCRATCH.append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete every folder of :func:`shared_dir`, once nothing reads them; returns their number."""
    dropped = 0
    while _SCRATCH:
        system, target = file_system(spark, _SCRATCH.pop())
        dropped += bool(system.delete(target, True))
    return dropped


@contextmanager
def passing_dir(spark: SparkSession) -> Iterator[str]:
    """A folder of :func:`shared_dir` that is deleted at the end of the block. What the block returns must not read it."""
    path = shared_dir(spark)
    try:
        yield path
    finally:
        system, target = file_system(spark, path)
        system.delete(target, True)
        if path in _SCRATCH:
            _SCRATCH.remove(path)


#: Rows that go to Python at once where texts are read.
BATCH_ROWS = 1_000
_ROWS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within the block, what is written hands Python at most ``BATCH_ROWS`` rows at once. A batch stands in memory
    outside the heap and again in Python, in every running task."""
    before = int(spark.conf.get(_ROWS_CONF))
    spark.conf.set(_ROWS_CONF, str(min(before, BATCH_ROWS) if before > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_ROWS_CONF, str(before))


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(*sessions: SparkSession) -> Iterator[None]:
    """Within the block, what a finished write has shuffled is deleted at once; else it stays on disk until the driver
    happens to collect its garbage. No frame that is acted on inside may be acted on again outside."""
    before = [(s, s.conf.get(_DROP_SHUFFLES)) for s in sessions]
    for s in sessions:
        s.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        for s, value in reversed(before):
            s.conf.set(_DROP_SHUFFLES, value)


def materialise(df: DataFrame, within: str | None = None, **options) -> DataFrame:
    """Cut lineage through a written table that survives the loss of executors; in a folder of its own, or ``within`` another.
    ``options`` go to its writer."""
    path = f"{within or shared_dir(df.sparkSession)}/table" + (f"-{uuid.uuid4().hex}" if within else "")
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

