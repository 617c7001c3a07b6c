"""Row-returning reads: search, pages, lookups, related events, timelines."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..schema import MAX_PAGE, is_active
from .aggregates import on_days

EVENT_FILTERS = ("event_type", "source_ip", "severity", "source", "username")
RELATED = 50
RELATED_FIELDS = ["event_id", "timestamp", "event_type", "source", "username", "status", "severity", "message"]


def filter_events(
    events: DataFrame, *, start: datetime | None = None, end: datetime | None = None,
    q: str | None = None, **equal: str | None,
) -> DataFrame:
    """Every given condition must hold; `q` is a case-insensitive LIKE fragment of the message."""
    unknown = set(equal) - set(EVENT_FILTERS)
    if unknown:
        raise ValueError(f"cannot filter on {sorted(unknown)}")
    df = events
    for name, value in equal.items():
        if value:
            df = df.filter(F.col(name) == value)
    if start is not None:
        df = df.filter(F.col("timestamp") >= F.lit(start))
    if end is not None:
        df = df.filter(F.col("timestamp") <= F.lit(end))
    df = on_days(df, start, end)
    if q:
        df = df.filter(F.col("message").ilike(f"%{q}%"))
    return df


def page(df: DataFrame, order: str, tie: str, limit: int, offset: int) -> DataFrame:
    """One page, newest first. Limits are clamped to 1..200."""
    limit = max(1, min(limit, MAX_PAGE))
    return df.orderBy(F.desc(order), F.asc(tie)).offset(max(0, offset)).limit(limit)


def search_events(events: DataFrame, limit: int = 50, offset: int = 0, **filters) -> tuple[DataFrame, DataFrame]:
    """(page, one-row total) of the matching events."""
    hits = filter_events(events, **filters)
    return page(hits, "timestamp", "event_id", limit, offset), hits.agg(F.count(F.lit(1)).alias("total"))


def event_by_id(events: DataFrame, event_id: str) -> DataFrame:
    return events.filter(F.col("event_id") == event_id)


def recent_events_for_ip(events: DataFrame, source_ip: str, limit: int = 25) -> DataFrame:
    hits = events.filter(F.col("source_ip") == source_ip)
    return hits.orderBy(F.desc("timestamp"), F.asc("event_id")).limit(min(limit, MAX_PAGE))


def filter_alerts(
    alerts: DataFrame, *, status: str | None = None, active_only: bool = False,
    severity: str | None = None, rule_id: str | None = None, source_ip: str | None = None,
) -> DataFrame:
    df = alerts
    if status:
        df = df.filter(F.col("status") == status)
    elif active_only:
        df = df.filter(is_active(F.col("status")))
    for name, value in (("severity", severity), ("rule_id", rule_id), ("source_ip", source_ip)):
        if value:
            df = df.filter(F.col(name) == value)
    return df


def search_alerts(alerts: DataFrame, limit: int = 50, offset: int = 0, **filters) -> tuple[DataFrame, DataFrame]:
    """(page, one-row total) of the matching alerts."""
    hits = filter_alerts(alerts, **filters)
    return page(hits, "last_seen", "alert_id", limit, offset), hits.agg(F.count(F.lit(1)).alias("total"))


def alert_by_id(alerts: DataFrame, alert_id: str) -> DataFrame:
    return alerts.filter(F.col("alert_id") == alert_id)


def newest_per_ip(events: DataFrame, limit: int = RELATED) -> DataFrame:
    """The newest `limit` events of every source address.

    Spark applies the limit in each task before the shuffle, so a busy address sends few rows.
    """
    rank = F.row_number().over(W.partitionBy("source_ip").orderBy(F.desc("timestamp"), F.asc("event_id")))
    return events.filter("source_ip is not null").withColumn("n", rank).filter(F.col("n") <= limit).drop("n")


def related_events(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Newest events of each alert's source address (C7), for all alerts at once."""
    keyed = alerts.filter("source_ip is not null").select("alert_id", "source_ip")
    # only addresses with an alert are ranked
    wanted = events.select("source_ip", *RELATED_FIELDS).join(keyed.select("source_ip").distinct(), "source_ip", "left_semi")
    recent = newest_per_ip(wanted)
    return keyed.join(recent, "source_ip").select("alert_id", *RELATED_FIELDS)


def recent_by_kind(alerts: DataFrame, kinds: list[str], limit: int = 25) -> DataFrame:
    """Newest alerts of the given detection kinds."""
    hits = alerts.filter(F.col("detection_kind").isin(kinds))
    return hits.orderBy(F.desc("last_seen"), F.asc("alert_id")).limit(min(limit, MAX_PAGE))


def latest_alerts(versions: DataFrame, keep: int = 80) -> DataFrame:
    """Newest version of each alert, newest alerts first."""
    rank = F.row_number().over(W.partitionBy("alert_id").orderBy(F.desc("updated_at"), F.desc("event_count")))
    newest = versions.withColumn("n", rank).filter("n = 1").drop("n")
    return newest.orderBy(F.desc("updated_at"), F.asc("alert_id")).limit(keep)


# Labels of event types whose name is not just the words capitalised.
TYPE_LABELS = {
    "authentication_failure": "Auth Failure", "authentication_success": "Auth Success",
    "http_request": "HTTP Request", "dns_query": "DNS Query", "db_query": "DB Query",
    "db_error": "DB Error", "application_event": "App Event",
}


def type_label(col: Column) -> Column:
    out = F.initcap(F.replace(col, F.lit("_"), F.lit(" ")))
    for name, label in TYPE_LABELS.items():
        out = F.when(col == name, label).otherwise(out)
    return out


def alert_timeline(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Everything shown on an alert's timeline (C11): alert_id, at, kind, label, detail."""
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, at: Column, kind: str, label: Column, detail: Column = none) -> DataFrame:
        return df.select("alert_id", at.alias("at"), F.lit(kind).alias("kind"), label.alias("label"), detail.alias("detail"))

    proof = alerts.select("alert_id", F.explode("evidence").alias("e"))
    shown = proof.select("alert_id", F.col("e.event_id").alias("event_id"))
    last = alerts.select("alert_id", "last_seen")
    more = (
        related_events(alerts, events).join(last, "alert_id").filter("timestamp <= last_seen")
        .join(shown, ["alert_id", "event_id"], "left_anti")
    )
    sep = F.lit(" · ")
    label = F.concat(
        type_label(F.col("event_type")),
        F.when(F.coalesce(F.col("username"), F.lit("")) != "", F.concat(sep, "username")).otherwise(""),
        F.when(F.col("status").isNotNull(), F.concat(sep, "status")).otherwise(""),
    )
    history = alerts.select("alert_id", F.explode("status_history").alias("h"))
    parts = [
        rows(proof, F.col("e.timestamp"), "event", F.col("e.summary")),
        rows(more, F.col("timestamp"), "event", label),
        rows(alerts, F.col("first_seen"), "alert", F.lit("Correlation window opened")),
        rows(alerts, F.col("last_seen"), "alert", F.concat(
            F.col("title"), F.lit(" — alert raised (×"), F.col("event_count").cast("string"), F.lit(")"))),
        rows(history, F.col("h.at"), "status",
             F.concat(F.lit("Status → "), F.replace(F.col("h.to"), F.lit("_"), F.lit(" "))),
             F.concat(F.lit("by "), F.col("h.by"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
