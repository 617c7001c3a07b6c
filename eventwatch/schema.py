"""Row types and fixed vocabularies shared by every module (data model)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Accepted vocabulary of the enumerated fields.
SEVERITIES = ["info", "low", "medium", "high", "critical"]
SOURCE_TYPES = [
    "linux_server", "web_server", "firewall", "database", "application",
    "identity", "dns", "scheduler", "unknown",
]
EVENT_TYPES = [
    "authentication_success", "authentication_failure", "logout", "privilege_escalation",
    "firewall_allow", "firewall_deny", "connection_attempt", "dns_query", "network_flow",
    "http_request", "db_query", "db_error", "application_event", "scheduled_job",
    "config_change", "unknown",
]
EVENT_STATUSES = ["success", "failure", "allowed", "denied", "blocked", "error", "info"]
ALERT_STATUSES = ["open", "acknowledged", "investigating", "resolved", "false_positive"]
ACTIVE_STATUSES = ["open", "acknowledged", "investigating"]
TERMINAL_STATUSES = ["resolved", "false_positive"]
DETECTION_KINDS = ["rule", "anomaly", "ml"]

# List sizes kept on an alert, and result page sizes.
MAX_EVIDENCE = 25
MAX_INVOLVED = 50
MAX_HISTORY = 25
MAX_PAGE = 200
MAX_TOP = 50

SECURITY_EVENT = T.StructType([
    T.StructField("event_id", T.StringType(), False),
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("ingested_at", T.TimestampType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("source_type", T.StringType(), False),
    T.StructField("event_type", T.StringType(), False),
    T.StructField("source_ip", T.StringType()),
    T.StructField("destination_ip", T.StringType()),
    T.StructField("destination_port", T.IntegerType()),
    T.StructField("username", T.StringType()),
    T.StructField("service", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("severity", T.StringType(), False),
    T.StructField("message", T.StringType()),
    T.StructField("bytes_out", T.LongType(), False),
    T.StructField("bytes_in", T.LongType(), False),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), False),
])

EVIDENCE = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("summary", T.StringType()),
])

HISTORY = T.StructType([
    T.StructField("from", T.StringType()),
    T.StructField("to", T.StringType()),
    T.StructField("at", T.TimestampType()),
    T.StructField("by", T.StringType()),
])

DETECTION = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("detection_kind", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("correlation_key", T.StringType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("affected_host", T.StringType()),
    T.StructField("recommended_action", T.StringType()),
    T.StructField("evidence", T.ArrayType(EVIDENCE)),
    T.StructField("involved_users", T.ArrayType(T.StringType())),
    T.StructField("involved_hosts", T.ArrayType(T.StringType())),
    T.StructField("event_count_hint", T.LongType()),
    T.StructField("anomaly_score", T.DoubleType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("triggered_at", T.TimestampType()),
])

ALERT = T.StructType([
    T.StructField("alert_id", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("correlation_key", T.StringType()),
    T.StructField("detection_kind", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("first_seen", T.TimestampType()),
    T.StructField("last_seen", T.TimestampType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("affected_host", T.StringType()),
    T.StructField("event_count", T.LongType()),
    T.StructField("involved_users", T.ArrayType(T.StringType())),
    T.StructField("involved_hosts", T.ArrayType(T.StringType())),
    T.StructField("evidence", T.ArrayType(EVIDENCE)),
    T.StructField("recommended_action", T.StringType()),
    T.StructField("anomaly_score", T.DoubleType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("status_history", T.ArrayType(HISTORY)),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

AUDIT = T.StructType([
    T.StructField("at", T.TimestampType()),
    T.StructField("actor", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("target_type", T.StringType()),
    T.StructField("target_id", T.StringType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("detail", T.MapType(T.StringType(), T.StringType())),
    T.StructField("note", T.StringType()),
])


def severity_rank(col: Column) -> Column:
    """0 for info up to 4 for critical."""
    return (F.array_position(F.lit(SEVERITIES), col) - 1).cast("int")


def is_active(status: Column) -> Column:
    """Non-terminal alert states (F8)."""
    return status.isin(ACTIVE_STATUSES)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us)
