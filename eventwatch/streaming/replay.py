"""Run the stream over a stored table to its end, for checking it against the batch result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.rules import RuleParams
from ..session import shared_dir
from ..sources.bridge import security_events
from .engine import Engine

DAY_US = 86_400_000_000


def mapped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return security_events(spark, sf_dir)


def in_order(events: DataFrame, parts: int) -> DataFrame:
    """The events with `part`: equal spans of time, one after the other."""
    us = F.unix_micros("timestamp")
    span = events.agg(F.min(us), F.max(us)).first()
    if span[0] is None:
        return events.withColumn("part", F.lit(0))
    width = (span[1] - span[0]) // parts + 1
    return events.withColumn("part", F.floor((us - span[0]) / width).cast("int"))


def with_late(parted: DataFrame) -> DataFrame:
    """One event in five comes a part later than its time, one in seventeen two parts later."""
    number = F.col("event_id").cast("bigint")
    return parted.withColumn("part", F.col("part") + F.when(number % 17 == 3, 2).when(number % 5 == 2, 1).otherwise(0))


def with_copies(parted: DataFrame) -> DataFrame:
    """Copies of one event in three arrive again, in the same part and in the two after it, dated up to two days later."""
    number = F.col("event_id").cast("bigint")
    again = F.when(number % 3 == 0, F.array(*[F.struct(F.lit(p).alias("p"), F.lit(d).alias("d")) for p, d in ((0, 0), (0, 1), (1, 1), (2, 2))]))
    each = parted.withColumn("c", F.explode(F.coalesce(again, F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("d"))))))
    return each.withColumns({"part": F.col("part") + F.col("c.p"), "timestamp": F.timestamp_micros(
        F.unix_micros("timestamp") + F.col("c.d") * DAY_US)}).drop("c")


def each_batch(step: Callable[[DataFrame, int], object]):
    return lambda source: source.writeStream.foreachBatch(step)


def replay(parted: DataFrame, root: str, sink: Callable[[DataFrame], object]) -> None:
    """Stream the rows part by part, a micro-batch each, over one checkpoint into the writer that `sink` makes."""
    spark = parted.sparkSession
    parted.write.partitionBy("part").parquet(f"{root}/parts")
    names = [f for f in parted.schema if f.name != "part"]
    schema = type(parted.schema)(names)
    for part in sorted(r.part for r in parted.select("part").distinct().collect()):
        # the source looks into one folder; a part becomes visible in it as a whole
        rows = spark.read.schema(schema).parquet(f"{root}/parts/part={part}")
        rows.write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1_000_000).parquet(f"{root}/in")
        query = sink(source).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()


def streamed(spark: SparkSession, sf_dir: str, params: RuleParams, late: bool = False, parts: int = 3) -> Engine:
    """The engine after the mapped events have gone through it; the second batch is delivered twice."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    engine = Engine(root, params, chunk_seconds=86_400)

    def step(rows: DataFrame, batch_id: int) -> None:
        for _ in range(2 if batch_id == 1 else 1):
            engine.step(rows, batch_id)

    parted = in_order(mapped_events(spark, sf_dir), parts)
    replay(with_late(parted) if late else parted, root, each_batch(step))
    return engine


def event_rows(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.unix_micros("timestamp").alias("us"), "event_type", "source_ip")


def rolled(spark: SparkSession, sf_dir: str, seconds: int) -> DataFrame:
    """The traffic rollup of the stream; an event long after the last closes every interval."""
    from .baselines import stream_rollup

    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = in_order(mapped_events(spark, sf_dir), 3)
    later = F.timestamp_micros(F.unix_micros("timestamp") + 30 * DAY_US)
    last = events.orderBy(F.desc("timestamp"), "event_id").limit(1).withColumns({"timestamp": later, "part": F.lit(3)})
    out = None

    def start(source: DataFrame):
        nonlocal out
        out = stream_rollup(source, seconds, "0 seconds")
        return out.writeStream.format("parquet").option("path", f"{root}/out")

    replay(events.unionByName(last), root, start)
    return spark.read.schema(out.schema).parquet(f"{root}/out")


def _stored(spark: SparkSession, parted: DataFrame) -> DataFrame:
    """Events the stream keeps, without running rules on them."""
    from ..sources.commits import Commits
    from ..sources.tables import append_events, read_events

    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def step(rows: DataFrame, batch_id: int) -> None:
        commits = Commits(spark, root)
        _, manifest = append_events(rows, root, batch_id, {**commits.latest(), "dropped": []})
        commits.commit(batch_id, manifest)

    replay(parted, root, each_batch(step))
    return event_rows(read_events(spark, root))


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stored by the stream after de-duplication."""
    return _stored(spark, in_order(mapped_events(spark, sf_dir), 2))


def stream_events_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same when many events come again, in the same and in later batches, dated on other days."""
    return _stored(spark, with_copies(in_order(mapped_events(spark, sf_dir), 6)))
