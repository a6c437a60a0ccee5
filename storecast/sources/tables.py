"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders of this driver's stored tables that are still there, each with its name in the catalog, if any.
_kept: dict[str, str | None] = {}
#: Of these the ones made by the step that :func:`settled` runs, if any, in this thread.
_step: ContextVar[list[str] | None] = ContextVar("step", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the one the context was given; a temporary one only where neither is set and the master is local (tests)."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(shared_dir, "own", None):
        shared_dir.own = tempfile.mkdtemp(prefix="spark-")
    return f"file://{shared_dir.own}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.

    Cuts the lineage, survives lost executors, and gives later joins the
    table's true size, so that the planner broadcasts it only when it is small.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    _made(path)
    return out


def _made(path: str, name: str | None = None) -> None:
    _kept[path] = name
    if (step := _step.get()) is not None:
        step.append(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` gives, as a table; the tables that it stored on the way are deleted once this one stands, or when it fails.

    Tables that ``make`` had stored by other threads stay.
    """
    made: list[str] = []
    token = _step.set(made)
    out = None
    try:
        out = written(make(), name)
    finally:
        _step.reset(token)
        for path in made:
            if path in _kept and (out is None or path != out._stored_at):
                _delete(spark, path)
    if (outer := _step.get()) is not None:
        outer.append(out._stored_at)
    return out


def bucketed(df: DataFrame, name: str, key: str = "Store", order: tuple[str, ...] = ("Date",), buckets: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, dealt into buckets by ``key`` (as many as a shuffle has partitions, or ``buckets``) and sorted in each.

    Windows, groups and joins by ``key`` (with or without further columns in a
    window or group) then need no exchange: all tables that are dealt into the
    same number of buckets lie side by side. The catalog knows the table until
    :func:`dropped`, or until the session ends.
    """
    spark = df.sparkSession
    own = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path, n = f"{shared_dir(spark)}/{own}", buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key, *order).option("path", path).option("compression", "zstd").saveAsTable(own)
    out = spark.table(own)
    out._stored_at, out._table = path, own
    _made(path, own)
    return out


#: Rows that a task holds at most when rows are dealt by :func:`dealt`, but for keys with more.
TASK_ROWS = 250_000


def dealt(df: DataFrame, key: str, rows: int, most: int | None = None) -> DataFrame:
    """``df`` dealt by ``key`` into as many tasks as its ``rows`` ask for.

    The planner would join the parts of an exchange until there is one per
    core, so that what a task sorts grows with the table. Tables of fewer rows
    get smaller tasks, ``most`` of them (or the partitions of a shuffle).
    """
    return df.repartition(tasks(df.sparkSession, rows, most), key)


def tasks(spark: SparkSession, rows: int, most: int | None = None) -> int:
    """How many tasks :func:`dealt` has for so many rows."""
    most = most or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-rows // TASK_ROWS), min(most, rows * 10 // TASK_ROWS))


def is_stored(df: DataFrame) -> bool:
    """Whether this is, as it stands, a table made here: reading it twice costs little."""
    return getattr(df, "_stored_at", None) is not None


def dropped(df: DataFrame) -> None:
    """Delete a table made by :func:`written` or :func:`bucketed` that nothing reads any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    if name := _kept.pop(path, None):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def released(spark: SparkSession) -> int:
    """Delete all tables that :func:`written` and :func:`bucketed` made in this driver and that are still there; how many these were.

    For the end of a job: results that were not written out yet can no longer be computed.
    """
    paths = list(_kept)
    for path in paths:
        _delete(spark, path)
    return len(paths)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever store the path is of."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where))
