"""Session helpers and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the engine relies on; cluster settings win when present."""
    b = (
        SparkSession.builder.appName("eventwatch")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        # a long session runs more distinct plans than the default cache of 100 compiled stages
        .config("spark.sql.codegen.cache.maxEntries", "1000")
        # building large expressions is several times faster without call-site capture
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temp folder only in local mode."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="eventwatch-"))
    return context.getCheckpointDir().rstrip("/")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` shuffled by `keys` into all of spark.sql.shuffle.partitions.

    Adaptive execution merges partitions by their compressed bytes. Rows that repeat each other shrink a
    hundredfold there, and one task would sort gigabytes; a number that is asked for is kept.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: By thread: the tables each open `scratch` has to delete, as (name, path).
_SCOPES: dict[int, list[list[tuple[str, str]]]] = {}


@contextmanager
def scratch(spark: SparkSession, keep: str | None = None) -> Iterator[None]:
    """Tables this thread materialises inside are deleted at the end, except those named `keep`; none else may be read afterwards."""
    scopes = _SCOPES.setdefault(threading.get_ident(), [])
    scopes.append([])
    try:
        yield
    finally:
        for name, table in scopes.pop():
            if name == keep:
                if scopes:
                    scopes[-1].append((name, table))
                continue
            path = spark._jvm.org.apache.hadoop.fs.Path(table)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside are deleted as each ends, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def larger_batches(spark: SparkSession, rows: int = 16384) -> Iterator[None]:
    """Arrow batches of up to `rows` rows for what runs inside: for narrow rows without texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Used where several branches consume one costly result. Unlike caching, the table survives
    lost executors, and unlike an RDD checkpoint it keeps column pruning and size statistics.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if scopes := _SCOPES.get(threading.get_ident()):
        scopes[-1].append((name, path))
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
