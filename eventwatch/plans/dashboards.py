"""Dashboard figures and the threat-activity bundle."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.enrich import enrich
from ..functions.text import exact_round
from ..operators import aggregates as agg
from ..schema import SEVERITIES, is_active
from ..session import materialize


def dashboard_kpis(events: DataFrame, alerts: DataFrame, as_of: datetime) -> DataFrame:
    """One row of figures, from one conditional-aggregate scan of each table."""
    hour, day = (F.lit(as_of - timedelta(hours=h)) for h in (1, 24))
    seen = events.filter(F.col("ingested_at") >= day).agg(
        F.count_if(F.col("ingested_at") >= hour).alias("events_last_hour"),
        F.count(F.lit(1)).alias("events_last_24h"),
    )
    status, live = F.col("status"), is_active(F.col("status"))
    state = alerts.agg(
        F.count_if(live).alias("active_alerts_total"),
        *[F.count_if(live & (F.col("severity") == s)).alias(f"{s}_alerts") for s in SEVERITIES],
        *[F.count_if(status == s).alias(f"{s}_alerts")
          for s in ("acknowledged", "investigating", "resolved", "false_positive")],
        F.count(F.lit(1)).alias("total_alerts"),
    )

    def ratio(top: str, bottom: str) -> Column:
        return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(0.0)

    # two one-row results become one row
    names = seen.columns + state.columns
    both = seen.unionByName(state, allowMissingColumns=True).agg(*[F.max(n).alias(n) for n in names])
    return both.withColumns({
        # all alerts over the last day's events, as defined by the dashboard
        "detection_rate": ratio("total_alerts", "events_last_24h"),
        "false_positive_rate": ratio("false_positive_alerts", "total_alerts"),
    }).withColumns({
        "detection_rate": exact_round("detection_rate", 5),
        "false_positive_rate": exact_round("false_positive_rate", 3),
    })


#: Grouping columns of the bundle's parts over events and over alerts.
EVENT_PARTS = {"events_timeseries": ["bucket"], "event_severity": ["severity"], "event_types": ["event_type"],
               "top_source_ips": ["source_ip"], "top_event_sources": ["source", "source_type"]}
ALERT_PARTS = {"alerts_timeseries": ["bucket", "severity"], "rule_frequency": ["rule_id"], "top_attacked_hosts": ["affected_host"]}


def _grouped(df: DataFrame, parts: dict[str, list[str]], measures: list[Column]) -> DataFrame:
    """All groupings of `parts` in one aggregation, a row naming its part."""
    columns = list(dict.fromkeys(c for keys in parts.values() for c in keys))
    # one bit per column, set where the column is not part of the grouping
    bits = {name: sum(2 ** (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in keys) for name, keys in parts.items()}
    part = None
    for name, value in bits.items():
        part = F.when(F.grouping_id() == value, name) if part is None else part.when(F.grouping_id() == value, name)
    sets = [[F.col(c) for c in keys] for keys in parts.values()]
    return df.groupingSets(sets, *columns).agg(part.alias("part"), *measures)


def threat_bundle(
    events: DataFrame, alerts: DataFrame, as_of: datetime, minutes: int = 180, bucket_seconds: int = 300,
) -> tuple[DataFrame, DataFrame]:
    """(event groups, alert groups): every grouping of the threat page, from one scan of each table."""
    since = F.lit(as_of - timedelta(minutes=minutes))
    seen = events.filter(F.col("timestamp") >= since).select(
        agg.bucket(F.col("timestamp"), bucket_seconds).alias("bucket"), "severity", "event_type", "source_ip", "source", "source_type")
    by_event = _grouped(seen, EVENT_PARTS, [
        F.count(F.lit(1)).alias("count"), F.count_if(F.col("event_type") == "authentication_failure").alias("auth_failures"),
        F.count_if(F.col("severity").isin("high", "critical")).alias("high_severity_events")])
    # rule activity is over all time, the rest over the range
    inside = F.col("first_seen") >= since
    raised = alerts.select(agg.bucket(F.col("first_seen"), max(bucket_seconds, 300)).alias("bucket"), "severity", "rule_id", "affected_host",
                           "event_count", "status", "last_seen", inside.alias("inside"))
    by_alert = _grouped(raised, ALERT_PARTS, [
        F.count_if("inside").alias("count"), F.sum(F.when(F.col("inside"), F.col("event_count"))).alias("event_count"),
        F.count_if(F.col("inside") & (F.col("severity") == "critical")).alias("critical_alerts"),
        F.count(F.lit(1)).alias("trigger_count"), F.count_if(is_active(F.col("status"))).alias("active_count"),
        F.max("last_seen").alias("last_triggered")])
    return by_event, by_alert


def threat_activity(
    events: DataFrame, alerts: DataFrame, as_of: datetime, minutes: int = 180, bucket_seconds: int = 300,
) -> dict[str, DataFrame]:
    """The figures of the threat page, all over one time range.

    Each table is aggregated once, with a grouping set per part, and the small result is stored; the parts
    are taken from it.
    """
    by_event, by_alert = (materialize(d, "bundle") for d in threat_bundle(events, alerts, as_of, minutes, bucket_seconds))
    e = {name: by_event.filter(F.col("part") == name) for name in EVENT_PARTS}
    a = {name: by_alert.filter(F.col("part") == name) for name in ALERT_PARTS}
    count = F.col("count")

    def top(df: DataFrame, by: str, *ties: str) -> DataFrame:
        return df.orderBy(F.desc(by), *ties).limit(10)

    return {
        "events_timeseries": e["events_timeseries"].select("bucket", "count").orderBy("bucket"),
        "alerts_timeseries": a["alerts_timeseries"].filter(count > 0).select("bucket", "severity", "count").orderBy("bucket", "severity"),
        "event_severity": e["event_severity"].select("severity", "count"),
        "event_types": e["event_types"].select("event_type", "count").orderBy(F.desc("count"), "event_type"),
        "rule_frequency": a["rule_frequency"].select("rule_id", "trigger_count", "active_count", "last_triggered").orderBy(
            F.desc("trigger_count"), "rule_id"),
        "top_source_ips": enrich(top(e["top_source_ips"].filter("source_ip is not null").select(
            "source_ip", count.alias("event_count"), "auth_failures"), "event_count", "source_ip")),
        "top_attacked_hosts": top(a["top_attacked_hosts"].filter((count > 0) & F.col("affected_host").isNotNull()).select(
            F.col("affected_host").alias("host"), count.alias("alert_count"), "event_count", "critical_alerts"), "alert_count", "host"),
        "top_event_sources": top(e["top_event_sources"].select(
            F.col("source").alias("host"), "source_type", count.alias("event_count"), "high_severity_events"), "event_count", "host", "source_type"),
    }


# --- throughput samples written by streaming.listener ---------------------------------------

HISTORY = 241
MEASURES = [
    "events_per_second", "events_processed_per_second", "pipeline_latency_ms", "alerts_per_minute",
    "invalid_events_window", "duplicate_events_window", "pipeline_health_pct",
]


def performance_history(samples: DataFrame) -> DataFrame:
    """The last 241 samples, oldest first."""
    return samples.orderBy(F.desc("updated_at")).limit(HISTORY).orderBy("updated_at")


def current_throughput(samples: DataFrame, as_of: datetime, sample_age: int = 30, worker_age: int = 20) -> DataFrame:
    """Newest sample with its measures blanked when it is stale.

    `heartbeat_at` is when the writing query last reported.
    """
    newest = samples.orderBy(F.desc("updated_at")).limit(1)
    now = F.lit(as_of)

    def age(col: str) -> Column:
        return (F.unix_micros(now) - F.unix_micros(col)) / 1e6

    online = age("heartbeat_at") < worker_age
    fresh = online & (age("updated_at") < sample_age)
    return newest.select(
        "updated_at", online.alias("worker_online"), *[F.when(fresh, F.col(m)).alias(m) for m in MEASURES]
    )
