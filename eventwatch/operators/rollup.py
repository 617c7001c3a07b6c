"""Per-interval traffic figures and their long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import exact_round
from .aggregates import bucket

# The six figures, in the order every consumer uses.
METRICS = [
    "events_per_min", "auth_failures_per_min", "unique_source_ips", "outbound_mib_per_min",
    "db_errors_per_min", "firewall_denies_per_min",
]


def traffic_rollup(events: DataFrame, seconds: int = 60) -> DataFrame:
    """The six figures per interval; intervals without events are absent.

    Each task first reduces to (interval, address) groups, so a busy interval or address arrives
    at the reducers as a few rows per task.
    """
    kind = F.col("event_type")
    raw = events.groupBy(bucket(F.col("timestamp"), seconds).alias("minute")).agg(
        F.count(F.lit(1)).cast("double").alias("events_per_min"),
        F.count_if(kind == "authentication_failure").cast("double").alias("auth_failures_per_min"),
        F.count_distinct("source_ip").cast("double").alias("unique_source_ips"),
        (F.sum("bytes_out") / F.lit(1024 * 1024)).alias("outbound_mib_per_min"),
        F.count_if(kind == "db_error").cast("double").alias("db_errors_per_min"),
        F.count_if(kind == "firewall_deny").cast("double").alias("firewall_denies_per_min"),
    )
    return raw.withColumn("outbound_mib_per_min", exact_round("outbound_mib_per_min", 3))


def long_form(rollup: DataFrame) -> DataFrame:
    """One row per interval and metric: minute, metric, value."""
    return rollup.unpivot(["minute"], METRICS, "metric", "value")
