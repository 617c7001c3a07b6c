"""The fixed aggregate queries over events and alerts.

`since` is a timestamp; callers derive it from an explicit `as_of`, never from the clock. Group
keys here have few values or are combined in each task before the shuffle, so a dominant key
costs one row per task.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..schema import MAX_TOP, SEVERITIES, is_active

def rows() -> Column:
    return F.count(F.lit(1))


def _flag(cond: Column) -> Column:
    return F.count_if(cond)


def on_days(events: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """The matching condition on event_date, where the events have that partition column."""
    if "event_date" not in events.columns:
        return events
    if start is not None:
        events = events.filter(F.col("event_date") >= F.to_date(F.lit(start)))
    return events if end is None else events.filter(F.col("event_date") <= F.to_date(F.lit(end)))


def since_filter(df: DataFrame, column: str, since: datetime | None) -> DataFrame:
    """Rows from `since` on; on the stored event table the days before are never read."""
    if since is None:
        return df
    df = df.filter(F.col(column) >= F.lit(since))
    return on_days(df, since, None) if column == "timestamp" else df


def bucket(ts: Column, seconds: int) -> Column:
    """Start of the bucket holding `ts`, as epoch seconds."""
    return (F.floor(F.unix_micros(ts) / F.lit(1_000_000 * seconds)) * seconds).cast("bigint")


def count_since(events: DataFrame, since: datetime) -> DataFrame:
    return since_filter(events, "ingested_at", since).agg(rows().alias("events"))


def _top(df: DataFrame, by: str, ties: list[str], limit: int) -> DataFrame:
    return df.orderBy(F.desc(by), *[F.asc(t) for t in ties]).limit(min(limit, MAX_TOP))


def top_source_ips(events: DataFrame, since: datetime | None = None, limit: int = 10) -> DataFrame:
    df = since_filter(events, "timestamp", since).filter("source_ip is not null").groupBy("source_ip").agg(
        rows().alias("event_count"), _flag(F.col("event_type") == "authentication_failure").alias("auth_failures")
    )
    return _top(df, "event_count", ["source_ip"], limit)


def event_type_breakdown(events: DataFrame, since: datetime | None = None) -> DataFrame:
    df = since_filter(events, "timestamp", since).groupBy("event_type").agg(rows().alias("count"))
    return df.orderBy(F.desc("count"), "event_type")


def severity_breakdown(events: DataFrame, since: datetime | None = None) -> DataFrame:
    return since_filter(events, "timestamp", since).groupBy("severity").agg(rows().alias("count"))


def events_timeseries(events: DataFrame, since: datetime | None = None, bucket_seconds: int = 60) -> DataFrame:
    df = since_filter(events, "timestamp", since)
    return df.groupBy(bucket(F.col("timestamp"), bucket_seconds).alias("bucket")).agg(rows().alias("count")).orderBy("bucket")


def _alert_buckets(alerts: DataFrame, since: datetime | None, seconds: int) -> DataFrame:
    df = since_filter(alerts, "first_seen", since)
    return df.groupBy(bucket(F.col("first_seen"), seconds).alias("bucket"), "severity").agg(rows().alias("count"))


def alerts_timeseries(alerts: DataFrame, since: datetime | None = None, bucket_seconds: int = 300) -> DataFrame:
    return _alert_buckets(alerts, since, max(bucket_seconds, 300)).orderBy("bucket", "severity")


def severity_heatmap(alerts: DataFrame, since: datetime | None = None, minimum: int = 12) -> DataFrame:
    """Hour x severity counts; `available` says whether the total is large enough to show."""
    cells = _alert_buckets(alerts, since, 3600)
    # five cells per hour at most, so one task holds them all
    total = F.sum("count").over(W.partitionBy(F.lit(0)))
    return cells.withColumn("total", total).withColumn("available", F.col("total") >= minimum).orderBy("bucket", "severity")


def alert_series_pivot(alerts: DataFrame, since: datetime | None = None, bucket_seconds: int = 300) -> DataFrame:
    """Alert series with one column per severity."""
    series = _alert_buckets(alerts, since, max(bucket_seconds, 300))
    wide = series.groupBy("bucket").pivot("severity", SEVERITIES).agg(F.sum("count"))
    return wide.select("bucket", *[F.coalesce(s, F.lit(0)).alias(s) for s in SEVERITIES])


def series_total(series: DataFrame) -> DataFrame:
    return series.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))


def bucket_for_range(minutes: int) -> int:
    """Bucket length in seconds that suits a range of `minutes`."""
    for upto, seconds in ((15, 60), (60, 120), (360, 600)):
        if minutes <= upto:
            return seconds
    return 1800


def top_hosts(events: DataFrame, since: datetime | None = None, limit: int = 10) -> DataFrame:
    df = since_filter(events, "timestamp", since).groupBy(F.col("source").alias("host"), "source_type").agg(
        rows().alias("event_count"), _flag(F.col("severity").isin("high", "critical")).alias("high_severity_events")
    )
    return _top(df, "event_count", ["host", "source_type"], limit)


def affected_hosts(alerts: DataFrame, since: datetime | None = None, limit: int = 10) -> DataFrame:
    df = since_filter(alerts, "first_seen", since).filter("affected_host is not null")
    df = df.groupBy(F.col("affected_host").alias("host")).agg(
        rows().alias("alert_count"), F.sum("event_count").alias("event_count"),
        _flag(F.col("severity") == "critical").alias("critical_alerts"),
    )
    return _top(df, "alert_count", ["host"], limit)


def rule_activity(alerts: DataFrame, since: datetime | None = None) -> DataFrame:
    """Alerts, active alerts and last trigger per rule; all time unless `since` is given."""
    return since_filter(alerts, "first_seen", since).groupBy("rule_id").agg(
        rows().alias("trigger_count"), _flag(is_active(F.col("status"))).alias("active_count"),
        F.max("last_seen").alias("last_triggered"),
    )


def host_inventory(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row per reporting host with its alert count."""
    seen = events.groupBy(F.col("source").alias("hostname")).agg(
        F.max_by("source_type", F.struct("timestamp", "event_id")).alias("source_type"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        rows().alias("event_count"),
    )
    raised = alerts.groupBy(F.col("affected_host").alias("hostname")).agg(rows().alias("alert_count"))
    return seen.join(raised, "hostname", "left").withColumn("alert_count", F.coalesce("alert_count", F.lit(0)))


def status_severity_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("status", "severity").agg(rows().alias("count"))


def active_alert_gauge(alerts: DataFrame) -> DataFrame:
    """Open and acknowledged alerts by severity, without those under investigation."""
    return alerts.filter(F.col("status").isin("open", "acknowledged")).groupBy("severity").agg(rows().alias("count"))
