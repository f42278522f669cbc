"""Session settings and the shared folder where intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_LOCAL_FOLDERS: dict[str, str] = {}
_SCOPES: list[list[str]] = []


def local_session(cores: int | str = "*", app: str = "tidemark", driver_memory: str = "8g") -> SparkSession:
    """A session for tests and the bench. On a cluster, submit with its own settings instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """Folder for written intermediate tables: the one the cluster names, else a local one in local mode."""
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="tidemark-")
    return _LOCAL_FOLDERS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "table", outer: bool = False) -> DataFrame:
    """Write a derived table to the shared folder and read it back.

    The result survives the loss of executors, has no lineage, and its size is known from its
    files. Catalyst therefore decides from the measured size whether a join with it is broadcast
    (``spark.sql.autoBroadcastJoinThreshold``) or shuffled with skew handling; nothing here
    forces a broadcast. With ``outer`` the table outlives the innermost ``scratch_scope``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    for scope in (_SCOPES[:-1] if outer else _SCOPES)[-1:]:
        scope.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes the tables settled inside it at its end, when what follows from them has been written."""
    _SCOPES.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _SCOPES.pop():
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """Jobs run inside it hand rows to Python in Arrow batches of about ``size`` bytes, a longer row alone.

    A batch lies several times outside the heap of an executor and in its worker, so 10,000 long texts at once are dear.
    """
    before = spark.conf.get(BATCH_CONF, None)
    spark.conf.set(BATCH_CONF, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_CONF)
        else:
            spark.conf.set(BATCH_CONF, before)
