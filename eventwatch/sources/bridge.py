"""Driver tables -> SECURITY_EVENT: the mapping the queries and their oracles share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Query texts carried by the mapped db_query rows: eight suspicious, four ordinary.
SAMPLE_QUERIES = [
    "SELECT * FROM accounts WHERE id = 1 UNION SELECT login, secret FROM admins",
    "SELECT name FROM items WHERE sku = '' OR 1=1",
    "x'; DROP TABLE invoices",
    "SELECT table_name FROM information_schema.tables",
    "SELECT load_file('/etc/hosts')",
    "SELECT * FROM users",
    "SELECT id FROM members WHERE login = 'root' --",
    "SELECT 1 FROM pg_user WHERE sleep(5) IS NULL",
    "SELECT id, name FROM items WHERE id = $1",
    "UPDATE carts SET qty = ? WHERE id = ?",
    "SELECT count(*) FROM orders WHERE day = :day",
    "INSERT INTO audit (who, what) VALUES ($1, $2)",
]
PRIVESC_ACTIONS = ["sudo su -", "usermod -aG sudo bob", "cache.refresh"]


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `events` table as SECURITY_EVENT rows; a narrow projection, nothing shuffles."""
    raw = events_table(spark, sf_dir).select(
        "event_id", "user_id", "event_type", "value",
        F.col("ts").cast("timestamp").alias("ts"),
        F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("int").alias("k"),
    )
    e, k = F.col("event_type"), F.col("k")
    kind = (
        F.when(e == "error", "authentication_failure")
        .when(e == "signup", "authentication_success")
        .when(e == "click", "firewall_deny")
        .when(e == "purchase", "network_flow")
        .when(k % 2 == 0, "db_query")
        .otherwise("privilege_escalation")
    )
    view, auth = e == "view", e.isin("error", "signup")
    privesc = view & (k % 2 == 1)
    meta = F.map_from_arrays(
        F.array(F.lit("user_role"), F.lit("query"), F.lit("rows_returned")),
        F.array(
            F.when(F.col("user_id") % 4 == 0, "admin").otherwise("user"),
            _pick(SAMPLE_QUERIES, k % 12),
            (k * 100).cast("string"),
        ),
    )
    null = F.lit(None).cast("string")
    return raw.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").alias("timestamp"),
        F.timestamp_micros(F.unix_micros("ts") + (F.col("event_id") % 7) * 1_000_000).alias("ingested_at"),
        F.concat(F.lit("host-"), (F.col("user_id") % 5).cast("string")).alias("source"),
        F.when(auth | privesc, "linux_server").when(view, "database").otherwise("firewall").alias("source_type"),
        kind.alias("event_type"),
        F.concat(F.lit("203.0.113."), (F.col("user_id") % 16 + 1).cast("string")).alias("source_ip"),
        F.concat(F.lit("10.42.0."), (k % 4 + 1).cast("string")).alias("destination_ip"),
        (k + 1).cast("int").alias("destination_port"),
        F.concat(F.lit("user"), (F.col("user_id") % 11).cast("string")).alias("username"),
        null.alias("service"),
        F.when(privesc, _pick(PRIVESC_ACTIONS, k % 3)).alias("action"),
        F.when(e == "error", "failure").when(e == "click", "denied").when(e == "purchase", "allowed")
        .otherwise("success").alias("status"),
        _pick(["info", "low", "medium", "high", "critical"], k % 5).alias("severity"),
        F.concat(F.lit("event "), e, F.lit(" from k"), k.cast("string")).alias("message"),
        F.when(e == "purchase", F.floor(F.col("value") * 1048576)).otherwise(F.lit(0)).cast("bigint").alias("bytes_out"),
        F.lit(0).cast("bigint").alias("bytes_in"),
        meta.alias("metadata"),
    )


def triage_events(events: DataFrame) -> DataFrame:
    """Analyst "resolve" actions derived from the mapped events (successes with k < 3)."""
    return events.filter(
        (F.col("event_type") == "authentication_success") & (F.col("destination_port") <= 3)
    ).select(
        F.lit("RULE-001").alias("rule_id"),
        F.concat(F.lit("srcip:"), F.col("source_ip")).alias("correlation_key"),
        F.lit("resolved").alias("status"),
        F.col("timestamp").alias("at"),
        F.col("event_id").alias("request_id"),
        F.col("username").alias("actor"),
    )
