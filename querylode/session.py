"""Where a job may keep intermediate data, and how it cuts a long lineage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: dict[str, str] = {}
# Spark's setting that removes the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SPLIT, _OPEN = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
_ADVISED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_LEAST = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_PARTITIONS = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
# Shuffled bytes for a task, as far as the number of shuffle partitions allows.
ADVISED = 16 << 20
# The same where each row is worked on for long, as notebooks are that become documents, and the least that a task gets to
# keep all cores busy: rows that are alike take few bytes, and Spark joins small partitions by bytes alone.
ADVISED_WORK, LEAST_WORK = 1 << 20, 64 << 10
# Shuffled rows of a few numbers for a task, whatever the number of shuffle partitions: they take about as many bytes.
TASK_ROWS = 1_000_000
# Rows that go to Python at once: a vector of 1,024 numbers has 4 KB there, and 8 KB in each step of its scoring.
ARROW_ROWS = 1_000
# Rows that are shipped to all tasks at most, for a join that would else shuffle its other side. They pass through the driver.
SHIPPED = 500_000
_UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode a temporary one if it is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    app = spark.sparkContext.applicationId  # the setting itself is fixed once a session runs
    if app not in _made:
        _made[app] = tempfile.mkdtemp(prefix="querylode-")
    return _made[app]


def new_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nobody else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read back from the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def write_once(df: DataFrame, path: str) -> None:
    """Write the rows below ``path``. Shuffle files go with the end of the write, not when the driver happens to collect its
    garbage: whoever wants the rows again reads what was written."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)


def _bytes(setting: str) -> int:
    text = setting.lower().removesuffix("b")
    number = text.rstrip("kmg")
    return int(number) * _UNITS[text[len(number) :]]


@contextmanager
def small_tasks(spark: SparkSession, size: int, advised: int = ADVISED, least: int | None = None):
    """Jobs that run inside read at most ``size`` bytes of files in a task, but for row groups that are larger, aim at ``advised``
    bytes of shuffled data, at ``least`` so many to have a task for each core, and pass at most ``ARROW_ROWS`` rows to Python
    at once, so that a larger input means more tasks, not larger ones. Smaller settings of the session hold."""
    conf = spark.conf
    before = {k: conf.get(k) for k in (_SPLIT, _OPEN, _ADVISED, _LEAST, _ARROW_ROWS)}
    rows = int(before[_ARROW_ROWS])
    conf.set(_SPLIT, min(size, _bytes(before[_SPLIT])))
    conf.set(_OPEN, min(size // 8, _bytes(before[_OPEN])))
    conf.set(_ADVISED, min(advised, _bytes(before[_ADVISED])))
    if least is not None:
        conf.set(_LEAST, min(least, _bytes(before[_LEAST])))
    conf.set(_ARROW_ROWS, min(ARROW_ROWS, rows) if rows > 0 else ARROW_ROWS)  # 0 or less: any number
    try:
        yield
    finally:
        for k, v in before.items():
            conf.set(k, v)


@contextmanager
def enough_partitions(spark: SparkSession, rows: int):
    """Jobs that run inside deal up to ``rows`` shuffled rows to so many tasks that each gets about ``TASK_ROWS`` at most.
    Larger settings of the session hold."""
    conf = spark.conf
    before = {k: v for k in _PARTITIONS if (v := conf.get(k, None)) is not None}
    for k, v in before.items():
        conf.set(k, max(-(-rows // TASK_ROWS), int(v)))
    try:
        yield
    finally:
        for k, v in before.items():
            conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to the shared folder and read back: Spark knows their size when it plans joins."""
    path = new_dir(df.sparkSession, name)
    write_once(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shipped(rows: DataFrame, most: int = SHIPPED) -> DataFrame:
    """Stored rows, for a join with a table that may be large: they go to all tasks if they are few, else both sides are
    shuffled. Spark would choose by the bytes of files, which hold much more than they show where rows are alike, and what it
    ships passes through the driver."""
    return F.broadcast(rows) if rows.count() <= most else rows.hint("merge")
