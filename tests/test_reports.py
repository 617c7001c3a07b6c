"""Enrichment, catalogue and search details the oracles do not reach."""

import hashlib
from datetime import timedelta

from pyspark.sql import functions as F

from fixtures import T0
from eventwatch.schema import ALERT
from eventwatch.plans import dashboards
from eventwatch.functions.enrich import enrich_ip, no_enrichment
from eventwatch.operators import search
from eventwatch.operators.aggregates import bucket_for_range, series_total
from eventwatch.operators.correlate import correlate
from eventwatch.operators.triage import apply_triage
from eventwatch.plans.catalogue import catalogue, find_rule, upsert_catalogue, with_activity
from eventwatch.plans.detect import detect
from eventwatch.sources.tables import topic_rows


def enriched(spark, *ips):
    df = spark.createDataFrame([(i,) for i in ips], "ip string").select("ip", enrich_ip(F.col("ip")).alias("e"))
    return {r.ip: r.e for r in df.collect()}


def test_enrichment(spark):
    got = enriched(spark, "10.42.1.5", "not-an-ip", "2600::1", "fc00::1", *[f"198.51.100.{i}" for i in range(50)])
    assert got["10.42.1.5"].is_private and got["10.42.1.5"].asn == "AS-INTERNAL" and got["10.42.1.5"].reputation_score == 5
    assert (got["not-an-ip"].reputation, got["not-an-ip"].reputation_score, got["not-an-ip"].country) == ("neutral", 40, None)
    assert got["fc00::1"].is_private and not got["2600::1"].is_private
    for i in range(50):
        e = got[f"198.51.100.{i}"]
        h = hashlib.sha256(e.ip.encode()).digest()
        assert e.asn == f"AS{1000 + int.from_bytes(h[2:4], 'big') % 64000}"
        assert (e.reputation == "malicious") == (e.reputation_score >= 80) and (e.reputation == "clean") == (e.reputation_score < 25)
        if e.category in ("tor-exit", "scanner"):
            assert e.reputation_score >= 70
    none = spark.range(1).select(no_enrichment(F.lit("1.2.3.4")).alias("e")).first().e
    assert (none.reputation_score, none.provider) == (0, "none")


def test_catalogue(spark):
    rules = catalogue(spark)
    rows = {r.rule_id: r for r in rules.collect()}
    assert len(rows) == 9 and rows["RULE-004"].mitre_attack == ["T1548", "T1078"] and not rows["ML-001"].enabled
    assert rows["RULE-001"].parameters == '{"max_failures": 10, "window_seconds": 60}'
    for name in ("port_scan", "rule-003", "RULE-003"):
        assert find_rule(rules, name).first().rule_id == "RULE-003"
    old = rules.filter("rule_id <> 'RULE-002'").withColumn("enabled", F.col("rule_id") != "RULE-001").withColumn("name", F.lit("old"))
    merged = {r.rule_id: r for r in upsert_catalogue(old, rules).collect()}
    assert len(merged) == 9 and not merged["RULE-001"].enabled and merged["RULE-001"].name == "SSH/Service brute force"


def brute(make_events):
    return make_events([{"at": i, "event_type": "authentication_failure", "status": "failure", "source_ip": "203.0.113.9",
                         "username": "root", "message": f"Failed 100% login_{i}"} for i in range(30)])


def test_search_clamps_and_wildcards(make_events):
    events = brute(make_events)
    page, total = search.search_events(events, limit=0, q="FAILED")
    assert page.count() == 1 and total.first().total == 30
    page, _ = search.search_events(events, limit=10, offset=25)
    assert [r.event_id for r in page.collect()] == [f"e{i:05d}" for i in (4, 3, 2, 1, 0)]
    assert search.search_events(events, q="login_1_")[1].first().total == 10
    assert search.search_events(events, username="nobody", event_type=None)[1].first().total == 0


def test_alert_reads_and_timeline(spark, make_events):
    events = brute(make_events)
    alerts = correlate(detect(events)).drop("episode")
    a = alerts.first()
    assert a.event_count == 30 and len(a.evidence) == 21
    assert search.related_events(alerts, events).count() == 30
    req = spark.createDataFrame([(a.alert_id, "false_positive", T0 + timedelta(seconds=90), "ann", None, "q")],
                                "alert_id string, status string, at timestamp, actor string, note string, request_id string")
    after, _, _ = apply_triage(alerts, req)
    rows = search.alert_timeline(after, events).orderBy("at").collect()
    kinds = [r.kind for r in rows]
    # 21 evidence rows, 9 earlier events, opened, raised, one status change
    assert (kinds.count("event"), kinds.count("alert"), kinds.count("status")) == (30, 2, 1)
    assert rows[-1].label == "Status → false positive" and rows[-1].detail == "by ann"
    assert rows[0].label == "Auth Failure · root · failure"
    assert any(r.label == "Brute-force login activity from 203.0.113.9 — alert raised (×30)" for r in rows)
    active = with_activity(catalogue(spark), after)
    assert {r.rule_id: (r.trigger_count, r.active_count) for r in active.collect()}["RULE-001"] == (1, 0)
    assert search.latest_alerts(alerts.unionByName(after)).first().status == "false_positive"
    assert search.alert_by_id(after, a.alert_id).count() == 1


def test_small_helpers(spark, make_events):
    assert [bucket_for_range(m) for m in (5, 15, 60, 360, 361)] == [60, 60, 120, 600, 1800]
    assert series_total(spark.createDataFrame([], "bucket bigint, count bigint")).first().total == 0
    row = topic_rows(brute(make_events)).first()
    assert row.key == "203.0.113.9" and '"event_id":"e00000"' in row.value


def test_the_bundle_scans_each_table_once(spark, make_events, tmp_path):
    make_events([{"severity": s, "source_ip": ip} for s in ("low", "high") for ip in ("203.0.113.1", None)]).write.parquet(str(tmp_path / "e"))
    events = spark.read.parquet(str(tmp_path / "e"))
    spark.createDataFrame([], ALERT).write.parquet(str(tmp_path / "a"))
    alerts = spark.read.schema(ALERT).parquet(str(tmp_path / "a"))
    as_of = T0.replace(tzinfo=None) + timedelta(hours=1)
    for part in dashboards.threat_bundle(events, alerts, as_of):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 1 and plan.count("Aggregate [") == 1
    got = {name: [tuple(r) for r in df.collect()] for name, df in dashboards.threat_activity(events, alerts, as_of).items()}
    assert sorted(got["event_severity"]) == [("high", 2), ("low", 2)] and [r[:3] for r in got["top_source_ips"]] == [("203.0.113.1", 2, 0)]
    assert got["top_event_sources"] == [("ssh-server-01", "linux_server", 4, 2)] and got["event_types"] == [("unknown", 4)]
    assert got["rule_frequency"] == got["alerts_timeseries"] == got["top_attacked_hosts"] == []
