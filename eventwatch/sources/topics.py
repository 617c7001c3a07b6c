"""Raw event sources and topic sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_events(spark: SparkSession, fmt: str = "kafka", path: str | None = None, **options: str) -> DataFrame:
    """Streaming DataFrame with one JSON text per row in `value`.

    fmt "kafka" needs the Kafka connector on the classpath, `subscribe` (the topic) and
    `kafka.bootstrap.servers`; `maxOffsetsPerTrigger` bounds a micro-batch where it is given.
    fmt "text" reads JSON-lines files, `maxFilesPerTrigger` bounding a micro-batch.
    """
    reader = spark.readStream
    if fmt == "kafka":
        settings = {"startingOffsets": "latest", **options}
        return reader.format("kafka").options(**settings).load().selectExpr("cast(value as string) as value")
    return reader.format("text").options(**{"maxFilesPerTrigger": "1", **options}).load(path)


def read_events_batch(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as a batch DataFrame."""
    return spark.read.text(path)


def write_topic(rows: DataFrame, topic: str, servers: str, **options: str) -> None:
    """Write key/value rows to a Kafka topic, acknowledged by all replicas, compressed."""
    rows.write.format("kafka").options(**{
        "kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all",
        "kafka.compression.type": "gzip", **options,
    }).save()
