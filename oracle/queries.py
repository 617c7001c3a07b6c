"""Oracle SQL by query name."""

from __future__ import annotations

from .base import (
    ALERT_OUT, DET_OUT, DETS, FOLD, NO_EPISODES, RULE_SQL, frame, rnd, with_alerts, with_events,
)

SINCE = "epoch_us(TIMESTAMP '2024-01-15')"
AS_OF = "epoch_us(TIMESTAMP '2024-01-30 12:00:00')"
DAY_AGO = f"({AS_OF} - 86400000000)"
EVENT_VIEW = "us, event_id, event_type, source, source_ip, username, status, severity, message"
KEYS = "alert_id, rule_id, correlation_key, severity, status, event_count, last_us"
MATCH = ("severity = 'high' AND event_type = 'authentication_failure' AND message ILIKE '%K1%' "
         "AND us >= epoch_us(TIMESTAMP '2024-01-03') AND us <= epoch_us(TIMESTAMP '2024-01-28')")
METRICS = ["events_per_min", "auth_failures_per_min", "unique_source_ips", "outbound_mib_per_min",
           "db_errors_per_min", "firewall_denies_per_min"]


def bucket(col: str, seconds: int) -> str:
    return f"CAST(floor({col} / {seconds * 1_000_000}.0) * {seconds} AS BIGINT)"


def rollup(seconds: int) -> str:
    return f"""
SELECT {bucket('us', seconds)} AS minute, CAST(count(*) AS DOUBLE) AS events_per_min,
  CAST(count(*) FILTER (WHERE event_type = 'authentication_failure') AS DOUBLE) AS auth_failures_per_min,
  CAST(count(DISTINCT source_ip) AS DOUBLE) AS unique_source_ips,
  {rnd('CAST(sum(bytes_out) AS DOUBLE) / 1048576', 3)} AS outbound_mib_per_min,
  CAST(count(*) FILTER (WHERE event_type = 'db_error') AS DOUBLE) AS db_errors_per_min,
  CAST(count(*) FILTER (WHERE event_type = 'firewall_deny') AS DOUBLE) AS firewall_denies_per_min
FROM ev GROUP BY 1"""


LONG = f"UNPIVOT ({rollup(3600)}) ON {', '.join(METRICS)} INTO NAME metric VALUE value"

# The recurrence walked row by row.
EWMA = f"""
long AS (SELECT * FROM ({LONG})),
ordered AS (SELECT metric, minute, value, row_number() OVER (PARTITION BY metric ORDER BY minute) AS rn FROM long),
walk AS (
  SELECT metric, minute, value, rn, value AS mean, CAST(0 AS DOUBLE) AS var, CAST(0 AS DOUBLE) AS z,
         value AS next_mean, CAST(0 AS DOUBLE) AS next_var
  FROM ordered WHERE rn = 1
  UNION ALL
  SELECT metric, minute, value, rn, mean, var, z, mean + a * (value - mean),
         (1 - a) * (var + a * (value - mean) * (value - mean))
  FROM (
    SELECT *, CAST(0.3 AS DOUBLE) / (1 + greatest(0, abs(z) - 2.0)) AS a FROM (
      SELECT o.metric, o.minute, o.value, o.rn, w.next_mean AS mean, w.next_var AS var,
        CASE WHEN sqrt(w.next_var) < 1e-9 THEN 0 ELSE (o.value - w.next_mean) / sqrt(w.next_var) END AS z
      FROM walk w JOIN ordered o ON o.metric = w.metric AND o.rn = w.rn + 1
    )
  )
),
anom AS (
  SELECT metric, minute, {rnd('value', 3)} AS value, {rnd('mean', 3)} AS baseline_mean, {rnd('sqrt(var)', 3)} AS baseline_std,
    {rnd('z', 2)} AS z_score,
    {rnd('least(1.0, 0.5 + 0.5 * (1 - exp(-((abs(z) - 2.0) * (abs(z) - 2.0)) / 8.0)))', 3)} AS anomaly_score,
    metric || ' = ' || format('{{:.1f}}', value) || ' is ' || format('{{:.1f}}', abs(z)) || 'σ ' ||
    CASE WHEN z > 0 THEN 'above' ELSE 'below' END || ' the rolling baseline of ' || format('{{:.1f}}', mean) ||
    ' ± ' || format('{{:.1f}}', sqrt(var)) || ' (n=' || (rn - 1) || ')' AS reason
  FROM walk WHERE rn - 1 >= 20 AND abs(z) >= 2.0
)"""


def with_ewma(body: str) -> str:
    return "WITH RECURSIVE " + with_events("", EWMA).strip()[len("WITH "):] + "\n" + body


def rule(i: int, where: str = "true") -> str:
    return with_events(f"SELECT {DET_OUT} FROM d WHERE {where}", f"d AS ({RULE_SQL[i]()})")




def byte(i: int) -> str:
    return f"CAST('0x' || sha256(ip)[{2 * i + 1}:{2 * i + 2}] AS INT)"


def enriched(source: str, keep: str) -> str:
    """Enrichment by arithmetic on the hash; internal and invalid addresses by prefix."""
    inside = "(ip LIKE '10.%')"
    bad = "(NOT regexp_matches(ip, '^\\d+\\.\\d+\\.\\d+\\.\\d+$'))"

    def by(b: str, i: str, o: str) -> str:
        return f"CASE WHEN {bad} THEN {b} WHEN {inside} THEN {i} ELSE {o} END"

    return f"""
SELECT {keep}, {by('false', 'true', 'false')} AS is_private,
  {by('NULL', 'NULL', f"(['US','DE','NL','GB','FR','SG','BR','IN','RU','CN','UA','SE'])[{byte(0)} % 12 + 1]")} AS country,
  {by('NULL', "'AS-INTERNAL'", f"'AS' || (1000 + ({byte(2)} * 256 + {byte(3)}) % 64000)")} AS asn,
  {by('NULL', "'corporate'", 'cat')} AS category,
  {by("'neutral'", "'clean'", "CASE WHEN score >= 80 THEN 'malicious' WHEN score >= 55 THEN 'suspicious' WHEN score >= 25 THEN 'neutral' ELSE 'clean' END")} AS reputation,
  CAST({by('40', '5', 'score')} AS BIGINT) AS reputation_score
FROM (SELECT *, CASE WHEN cat IN ('tor-exit', 'scanner') THEN greatest({byte(4)} % 101, 70) ELSE {byte(4)} % 101 END AS score
  FROM (SELECT *, (['hosting','residential','corporate','tor-exit','scanner','vpn'])[{byte(1)} % 6 + 1] AS cat FROM ({source})))"""


TOP_IPS = """SELECT source_ip, count(*) AS event_count,
  count(*) FILTER (WHERE event_type = 'authentication_failure') AS auth_failures
FROM ev WHERE us >= {since} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
ACTIVITY = """SELECT rule_id, count(*) AS trigger_count, count(*) FILTER (WHERE status = 'open') AS active_count,
  max(last_us) AS last_triggered FROM alerts GROUP BY 1"""
HANDLES = [("RULE-001", "SSH_BRUTE_FORCE"), ("RULE-002", "PASSWORD_SPRAY"), ("RULE-003", "PORT_SCAN"),
           ("RULE-004", "PRIVILEGE_ESCALATION"), ("RULE-005", "SUSPICIOUS_SQL"), ("RULE-006", "DATA_EXFILTRATION"),
           ("RULE-007", "AUTH_ANOMALY"), ("ANOM-001", "TRAFFIC_ANOMALY"), ("ML-001", "ISOLATION_FOREST")]
CATALOGUE = "rules(rule_id, handle) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in HANDLES) + ")"
CAT_ACTIVITY = f"""SELECT r.rule_id, r.handle, coalesce(trigger_count, 0) AS trigger_count,
  coalesce(active_count, 0) AS active_count, last_triggered FROM rules r LEFT JOIN ({ACTIVITY}) USING (rule_id)"""
LABEL = """CASE event_type WHEN 'authentication_failure' THEN 'Auth Failure' WHEN 'authentication_success' THEN 'Auth Success'
  WHEN 'firewall_deny' THEN 'Firewall Deny' WHEN 'network_flow' THEN 'Network Flow' WHEN 'db_query' THEN 'DB Query'
  WHEN 'privilege_escalation' THEN 'Privilege Escalation' END"""
RECENT = "recent AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY source_ip ORDER BY us DESC, event_id) <= 50)"
RELATED = """related AS (SELECT a.alert_id, a.last_us, a.evidence, r.us, r.event_id, r.event_type, r.username, r.status
  FROM alerts a JOIN recent r USING (source_ip))"""

# Requests applied one at a time in order, by recursion over the request number.
TRIAGE_WALK = """
first_alerts AS (SELECT alert_id, correlation_key, source_ip FROM alerts),
req AS (
  SELECT f.alert_id, e.us, e.event_id AS request_id, e.username AS actor,
    (['acknowledged', 'investigating', 'resolved', 'open', 'false_positive'])[e.k % 5 + 1] AS target,
    row_number() OVER (PARTITION BY f.alert_id ORDER BY e.us, e.event_id) AS rn
  FROM ev e JOIN first_alerts f USING (source_ip) WHERE e.event_type = 'authentication_success'
),
tw AS (
  SELECT alert_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS before, 'open' AS state, '' AS outcome FROM first_alerts
  UNION ALL
  SELECT alert_id, rn, state, CASE WHEN outcome = 'changed' THEN target ELSE state END, outcome FROM (
    SELECT w.alert_id, r.rn, w.state, r.target,
      CASE WHEN w.state = r.target THEN 'unchanged'
           WHEN w.state IN ('resolved', 'false_positive') AND r.target <> 'open' THEN 'rejected'
           ELSE 'changed' END AS outcome
    FROM tw w JOIN req r ON r.alert_id = w.alert_id AND r.rn = w.rn + 1)
)"""


# The same over every alert and every success, with requests for a state that does not exist.
TRIAGE_ODD = (
    TRIAGE_WALK.replace("'open', 'false_positive'])[e.k % 5 + 1]", "'open', 'false_positive', 'bogus'])[e.k % 6 + 1]")
    .replace("CASE WHEN w.state = r.target", "CASE WHEN r.target = 'bogus' THEN 'rejected' WHEN w.state = r.target")
)


def with_triage(body: str, walk: str = TRIAGE_WALK) -> str:
    return "WITH RECURSIVE " + with_alerts("", walk).strip()[len("WITH "):] + "\n" + body


# What the faulty payloads should become, stated per fault instead of parsed from text.
NORMALIZED = """
SELECT CASE WHEN id % 3 = 0 THEN format('{:08x}-0000-4000-8000-00000000abcd', id) ELSE
    h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' ||
    (['8','9','a','b'])[CAST('0x' || h[17] AS INT) % 4 + 1] || h[18:20] || '-' || h[21:32] END AS event_id,
  CASE WHEN k IN (97, 98) THEN epoch_us(TIMESTAMP '2024-02-01') WHEN k % 4 = 0 THEN us - us % 1000000
       WHEN k % 4 = 2 THEN us - 7200000000 ELSE us END AS us,
  CASE WHEN k % 6 = 0 THEN 'unknown' ELSE 'host-' || k END AS source,
  CASE WHEN k % 5 = 0 THEN 'unknown' ELSE 'firewall' END AS source_type,
  CASE WHEN e = 'error' THEN 'authentication_failure' ELSE 'unknown' END AS event_type,
  CASE WHEN k % 10 IN (0, 1) THEN NULL WHEN k % 10 = 2 THEN '2001:db8::1' WHEN k % 10 = 3 THEN '10.0.0.7'
       ELSE '203.0.113.' || (user_id % 16 + 1) END AS source_ip,
  CAST(CASE WHEN k % 3 = 0 THEN 443 WHEN k % 3 = 1 AND k * 1000 <= 65535 THEN k * 1000 END AS INT) AS destination_port,
  'user' || user_id AS username,
  CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN 'denied' ELSE 'info' END AS status,
  CASE WHEN k % 2 = 0 THEN 'high' ELSE 'info' END AS severity,
  CASE WHEN k = 0 THEN NULL ELSE CAST(least(40 * k, 2048) AS BIGINT) END AS message_length,
  CAST(CASE WHEN k % 3 = 2 THEN k * 1048576 ELSE 0 END AS BIGINT) AS bytes_out,
  CASE WHEN k % 7 = 0 THEN 'tag=t' || k ELSE 'k=' || k || ';tag=m' || k END AS meta
FROM (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('ev-' || id)) AS h FROM raw)
WHERE k NOT IN (96, 99)"""

IPS = """SELECT DISTINCT ip FROM (SELECT source_ip AS ip FROM ev UNION ALL SELECT destination_ip FROM ev
  UNION ALL SELECT '198.51.' || destination_port || '.9' FROM ev UNION ALL SELECT 'bad-' || destination_port FROM ev)"""
H6 = frame("source_ip", 6 * 3600 * 1_000_000)
H1 = frame("source_ip", 3600 * 1_000_000)
FAIL = "event_type = 'authentication_failure'"

ORACLES: dict[str, str] = {
    "events_search_page": with_events(f"SELECT {EVENT_VIEW} FROM ev WHERE {MATCH} ORDER BY us DESC, event_id LIMIT 50 OFFSET 20"),
    "events_search_total": with_events(f"SELECT count(*) AS total FROM ev WHERE {MATCH}"),
    "event_by_id": with_events(f"SELECT {EVENT_VIEW} FROM ev WHERE event_id = '17'"),
    "recent_events_for_ip": with_events(
        f"SELECT {EVENT_VIEW} FROM ev WHERE source_ip = '203.0.113.5' ORDER BY us DESC, event_id LIMIT 25"),
    "count_since": with_events(f"SELECT count(*) AS events FROM ev WHERE ing_us >= {SINCE}"),
    "top_source_ips": with_events(TOP_IPS.format(since=SINCE)),
    "event_type_breakdown": with_events(f"SELECT event_type, count(*) AS count FROM ev WHERE us >= {SINCE} GROUP BY 1"),
    "severity_breakdown": with_events(f"SELECT severity, count(*) AS count FROM ev WHERE us >= {SINCE} GROUP BY 1"),
    "events_timeseries": with_events(f"SELECT {bucket('us', 600)} AS bucket, count(*) AS count FROM ev WHERE us >= {SINCE} GROUP BY 1"),
    "events_total": with_events(f"SELECT count(*) AS total FROM ev WHERE us >= {SINCE}"),
    "top_hosts": with_events(f"""SELECT source AS host, source_type, count(*) AS event_count,
        count(*) FILTER (WHERE severity IN ('high', 'critical')) AS high_severity_events
        FROM ev WHERE us >= {SINCE} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 50"""),
    "minute_rollup": with_events(rollup(60)),
    "hour_rollup": with_events(rollup(3600)),
    "stream_rollup": with_events(rollup(3600)),
    "metrics_long": with_events(LONG),
    "dedup_events": with_events("SELECT event_id, us, CAST(0 AS BIGINT) AS bytes_in FROM ev"),
    "normalize_raw": with_events(NORMALIZED),
    "normalize_rejects": with_events("""SELECT CASE WHEN k = 96 THEN 'undecodable' ELSE 'timestamp' END AS reason,
        count(*) AS rejected FROM raw WHERE k IN (96, 99) GROUP BY 1"""),
    "sliding_measures": with_events(f"""SELECT DISTINCT source_ip AS entity, us, count(*) OVER {H6} AS count,
        CAST(sum(bytes_out) OVER {H6} AS BIGINT) AS amount, count(DISTINCT username) OVER {H6} AS n_distinct,
        us - min(us) OVER {H6} AS span_us FROM ev"""),
    "sliding_probe": with_events(f"""SELECT DISTINCT source_ip AS entity, us, count(*) FILTER (WHERE {FAIL}) OVER {H1} AS count,
        count(DISTINCT username) FILTER (WHERE {FAIL}) OVER {H1} AS n_distinct
        FROM ev WHERE event_type IN ('authentication_failure', 'authentication_success')"""),
    "rule_001_brute_force": rule(1),
    "rule_001_breach": rule(1, "severity = 'critical'"),
    "rule_002_spray": rule(2),
    "rule_003_portscan": rule(3),
    "rule_004_privesc": rule(4),
    "rule_005_sql": rule(5),
    "rule_006_exfil": rule(6),
    "rule_007_authgeo": rule(7),
    "detections_all": with_events(f"SELECT {DET_OUT} FROM dets", DETS),
    "stream_detections": with_events(f"SELECT {DET_OUT} FROM dets", DETS),
    "stream_late_detections": with_events(f"SELECT {DET_OUT} FROM dets", DETS),
    "stream_events": with_events("SELECT event_id, us, event_type, source_ip FROM ev"),
    "stream_events_repeated": with_events("SELECT event_id, us, event_type, source_ip FROM ev"),
    "stream_alerts": with_events(f"SELECT {ALERT_OUT.replace('episode, ', '')} FROM alerts", DETS, NO_EPISODES, FOLD),
    "stream_late_alerts": with_events(f"SELECT {ALERT_OUT.replace('episode, ', '')} FROM alerts", DETS, NO_EPISODES, FOLD),
    "detections_disabled": with_events(f"SELECT {DET_OUT} FROM dets WHERE rule_id IN ('RULE-002', 'RULE-004', 'RULE-006')", DETS),
    "alerts_folded": with_events(f"SELECT {ALERT_OUT.replace('episode, ', '')} FROM alerts", DETS, NO_EPISODES, FOLD),
    "alerts_merged": with_events(f"SELECT {ALERT_OUT.replace('episode, ', '')} FROM alerts", DETS, NO_EPISODES, FOLD),
    "alert_episodes": with_alerts(f"SELECT {ALERT_OUT} FROM alerts"),
    "alerts_search_page": with_alerts(
        f"SELECT {KEYS} FROM alerts WHERE status = 'open' AND severity = 'high' ORDER BY last_us DESC, alert_id LIMIT 40 OFFSET 5"),
    "alerts_search_total": with_alerts("SELECT count(*) AS total FROM alerts WHERE status = 'resolved' AND rule_id = 'RULE-001'"),
    "alert_related_events": with_alerts("SELECT alert_id, us, event_id, event_type, username FROM related", RECENT, RELATED),
    "alert_timeline": with_alerts(f"""
        SELECT alert_id, unnest(evidence_us) AS us, 'event' AS kind, unnest(summaries) AS label FROM alerts
        UNION ALL SELECT alert_id, us, 'event', {LABEL} || ' · ' || username || ' · ' || status FROM related
          WHERE us <= last_us AND NOT list_contains(evidence, event_id)
        UNION ALL SELECT alert_id, first_us, 'alert', 'Correlation window opened' FROM alerts
        UNION ALL SELECT alert_id, last_us, 'alert', title || ' — alert raised (×' || event_count || ')' FROM alerts""",
        RECENT, RELATED),
    "recent_alerts_by_kind": with_alerts(f"SELECT {KEYS} FROM alerts ORDER BY last_us DESC, alert_id LIMIT 25"),
    "latest_alerts": with_alerts(f"""SELECT {KEYS} FROM alerts ORDER BY last_us DESC, alert_id LIMIT 80"""),
    "alerts_timeseries": with_alerts(
        f"SELECT {bucket('first_us', 3600)} AS bucket, severity, count(*) AS count FROM alerts WHERE first_us >= {SINCE} GROUP BY 1, 2"),
    "severity_heatmap": with_alerts(f"""SELECT *, CAST(sum(count) OVER () AS BIGINT) AS total, sum(count) OVER () >= 12 AS available FROM (
        SELECT {bucket('first_us', 3600)} AS bucket, severity, count(*) AS count FROM alerts WHERE first_us >= {SINCE} GROUP BY 1, 2)"""),
    "alert_series_pivot": with_alerts(f"""SELECT {bucket('first_us', 86400)} AS bucket, """ + ", ".join(
        f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in ("info", "low", "medium", "high", "critical"))
        + f" FROM alerts WHERE first_us >= {SINCE} GROUP BY 1"),
    "affected_hosts": with_alerts(f"""SELECT affected_host AS host, count(*) AS alert_count, CAST(sum(event_count) AS BIGINT) AS event_count,
        count(*) FILTER (WHERE severity = 'critical') AS critical_alerts FROM alerts WHERE first_us >= {SINCE}
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""),
    "rule_activity": with_alerts(ACTIVITY),
    "threat_rule_frequency": with_alerts(f"SELECT rule_id, trigger_count, last_triggered FROM ({ACTIVITY})"),
    "host_inventory": with_alerts("""SELECT h.*, coalesce(a.alert_count, 0) AS alert_count FROM (
        SELECT source AS hostname, arg_max(source_type, us) AS source_type, min(us) AS first_seen, max(us) AS last_seen,
          count(*) AS event_count FROM ev GROUP BY 1) h
        LEFT JOIN (SELECT affected_host AS hostname, count(*) AS alert_count FROM alerts GROUP BY 1) a USING (hostname)"""),
    "status_severity_counts": with_alerts("SELECT status, severity, count(*) AS count FROM alerts GROUP BY 1, 2"),
    "active_alert_gauge": with_alerts("SELECT severity, count(*) AS count FROM alerts WHERE status = 'open' GROUP BY 1"),
    "catalogue_activity": with_alerts(CAT_ACTIVITY, CATALOGUE),
    "catalogue_totals": with_alerts("SELECT CAST(9 AS BIGINT) AS count, count(*) AS total_triggers FROM alerts"),
    "rule_lookup": with_alerts(f"SELECT * FROM ({CAT_ACTIVITY}) WHERE handle = 'PORT_SCAN'", CATALOGUE),
    "dashboard_kpis": with_alerts(f"""SELECT e.*, a.*, CASE WHEN events_last_24h > 0 THEN {rnd('total_alerts / events_last_24h', 5)} ELSE 0 END AS detection_rate,
        CAST(CASE WHEN total_alerts > 0 THEN {rnd('false_positive_alerts / total_alerts', 3)} ELSE 0 END AS DOUBLE) AS false_positive_rate
        FROM (SELECT count(*) FILTER (WHERE ing_us >= {AS_OF} - 3600000000) AS events_last_hour,
                count(*) AS events_last_24h FROM ev WHERE ing_us >= {DAY_AGO}) e,
        (SELECT count(*) FILTER (WHERE status = 'open') AS active_alerts_total, """ + ", ".join(
        f"count(*) FILTER (WHERE status = 'open' AND severity = '{s}') AS {s}_alerts" for s in ("info", "low", "medium", "high", "critical"))
        + ", " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}_alerts" for s in ("acknowledged", "investigating", "resolved", "false_positive"))
        + ", count(*) AS total_alerts FROM alerts) a"),
    "threat_top_source_ips": with_events(enriched(f"SELECT *, source_ip AS ip FROM ({TOP_IPS.format(since=DAY_AGO)})",
                                                  "source_ip, event_count, auth_failures")),
    "threat_top_hosts": with_alerts(f"""SELECT affected_host AS host, count(*) AS alert_count, CAST(sum(event_count) AS BIGINT) AS event_count,
        count(*) FILTER (WHERE severity = 'critical') AS critical_alerts FROM alerts WHERE first_us >= {DAY_AGO}
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""),
    "threat_events_timeseries": with_events(
        f"SELECT {bucket('us', 3600)} AS bucket, count(*) AS count FROM ev WHERE us >= {DAY_AGO} GROUP BY 1"),
    "threat_alerts_timeseries": with_alerts(
        f"SELECT {bucket('first_us', 3600)} AS bucket, severity, count(*) AS count FROM alerts WHERE first_us >= {DAY_AGO} GROUP BY 1, 2"),
    "threat_event_severity": with_events(f"SELECT severity, count(*) AS count FROM ev WHERE us >= {DAY_AGO} GROUP BY 1"),
    "threat_event_types": with_events(f"SELECT event_type, count(*) AS count FROM ev WHERE us >= {DAY_AGO} GROUP BY 1"),
    "threat_top_event_sources": with_events(f"""SELECT source AS host, source_type, count(*) AS event_count,
        count(*) FILTER (WHERE severity IN ('high', 'critical')) AS high_severity_events FROM ev WHERE us >= {DAY_AGO}
        GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10"""),
    "alert_by_id": with_alerts(f"SELECT {KEYS} FROM alerts ORDER BY last_us DESC, alert_id LIMIT 1"),
    "catalogue_upsert": with_alerts("""SELECT rule_id, handle, rule_id <> 'ML-001' AND rule_id NOT IN (SELECT rule_id FROM alerts) AS enabled
        FROM rules""", CATALOGUE),
    "feed_events": with_events("""SELECT batch, event_id, severity FROM (
        SELECT *, CAST((us - min(us) OVER ()) // ((max(us) OVER () - min(us) OVER ()) // 3 + 1) AS BIGINT) AS batch FROM ev)
        QUALIFY row_number() OVER (PARTITION BY batch ORDER BY us DESC, event_id) <= 100"""),
    "feed_alerts": with_events("SELECT alert_id, event_count FROM alerts", DETS, NO_EPISODES, FOLD),
    "topic_messages": with_events("SELECT source_ip AS key, event_id, event_type, CAST(bytes_out AS VARCHAR) AS bytes_out FROM ev"),
    "events_timeseries_range": with_events(f"SELECT {bucket('us', 1800)} AS bucket, count(*) AS count FROM ev WHERE us >= {SINCE} GROUP BY 1"),
    "audit_log": with_triage("""SELECT r.alert_id AS target_id, r.request_id, r.actor, r.us FROM tw w JOIN req r USING (alert_id, rn)
        WHERE w.outcome = 'changed'"""),
    "ip_enrichment": with_events(enriched(IPS, "ip")),
    "ewma_steps": with_ewma("SELECT metric, minute, round(mean, 4) AS mean, round(z, 4) AS z, rn - 1 AS n FROM walk"),
    "ewma_baseline": with_ewma(f"""SELECT metric, {rnd('next_mean', 2)} AS mean, {rnd('sqrt(next_var)', 2)} AS std, rn AS samples,
        rn >= 20 AS ready FROM walk QUALIFY row_number() OVER (PARTITION BY metric ORDER BY rn DESC) = 1"""),
    "anomaly_alerts": with_ewma(f"""SELECT 'ANOM-001' AS rule_id, 'anomaly' AS detection_kind, 'Statistical anomaly: ' || metric AS title,
        reason AS description, CASE WHEN anomaly_score < 0.85 THEN 'medium' ELSE 'high' END AS severity,
        {rnd('least(0.95, anomaly_score)', 2)} AS confidence,
        'anomaly:' || metric || ':' || strftime(make_timestamp(minute * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS correlation_key,
        anomaly_score, minute FROM anom"""),
    "anomaly_listing": with_ewma(f"""SELECT 'ANOM-001' AS rule_id, metric, value AS current_value, baseline_mean, z_score,
        CASE WHEN baseline_mean > 0 THEN {rnd('(value - baseline_mean) / baseline_mean * 100', 1)} END AS deviation_pct,
        CASE WHEN anomaly_score < 0.85 THEN 'medium' ELSE 'high' END AS severity,
        {rnd('least(0.95, anomaly_score)', 2)} AS confidence, anomaly_score, 'open' AS status, minute
        FROM anom ORDER BY minute DESC, md5('ANOM-001|' || 'anomaly:' || metric || ':' ||
          strftime(make_timestamp(minute * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') || '|' || 'anomaly:' || metric || ':' ||
          strftime(make_timestamp(minute * 1000000), '%Y-%m-%dT%H:%M:%S+00:00')) LIMIT 30"""),
    "triage_transitions": with_triage("""SELECT f.alert_id, f.correlation_key, w.state AS status, least(m.n, 25) AS history, coalesce(m.moves, '') AS moves
        FROM first_alerts f
        JOIN (SELECT alert_id, arg_max(state, rn) AS state FROM tw GROUP BY 1) w USING (alert_id)
        JOIN (SELECT alert_id, count(*) FILTER (WHERE outcome = 'changed') AS n,
                array_to_string((list(before || '>' || state ORDER BY rn) FILTER (WHERE outcome = 'changed'))[-25:], ',') AS moves
              FROM tw GROUP BY 1) m USING (alert_id)"""),
    "triage_audit": with_triage("""SELECT r.alert_id AS target_id, r.us, r.actor, 'alert_status_change' AS action, r.request_id,
        w.before AS moved_from, w.state AS moved_to FROM tw w JOIN req r USING (alert_id, rn) WHERE w.outcome = 'changed'"""),
    "triage_rejected": with_triage("""SELECT r.alert_id, r.us, w.before AS moved_from, r.target AS moved_to, 'rejected' AS reason
        FROM tw w JOIN req r USING (alert_id, rn) WHERE w.outcome = 'rejected'"""),
    "triage_unknown_status": with_triage("""SELECT f.alert_id, coalesce(w.before, f.state) AS moved_from, w.target AS moved_to, w.outcome, w.us
        FROM (SELECT alert_id, 'open' AS state FROM first_alerts) f
        JOIN (SELECT alert_id, r.us, r.target, w.before, w.outcome FROM tw w JOIN req r USING (alert_id, rn)) w USING (alert_id)
        WHERE w.outcome IN ('changed', 'rejected')""", TRIAGE_ODD),
}
