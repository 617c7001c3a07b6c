"""Rule behaviour on small literal streams."""

import random

import pytest

from eventwatch.operators.rules import RuleParams
from eventwatch.plans.detect import detect, enabled_rules


def failures(n, ip="203.0.113.9", user=lambda i: f"user{i}", step=1.0, **kw):
    return [{"at": i * step, "event_type": "authentication_failure", "status": "failure", "source_ip": ip,
             "username": user(i), **kw} for i in range(n)]


def fired(df, rule_id):
    return sorted(df.filter(df.rule_id == rule_id).collect(), key=lambda r: (r.triggered_at, r.event_id))


def test_brute_force_fires_from_the_tenth_failure(make_events):
    got = fired(detect(make_events(failures(12)), enabled=["RULE-001"]), "RULE-001")
    assert [r.event_id for r in got] == ["e00009", "e00010", "e00011"]
    assert [r.event_count_hint for r in got] == [10, 11, 12]
    assert got[0].severity == "high" and got[0].confidence == 0.6
    assert got[0].title == "Brute-force login activity from 203.0.113.9"
    assert got[0].description == (
        "10 failed authentication attempts from 203.0.113.9 within 9s (threshold 10/60s), "
        "targeting 10 distinct account(s).")
    assert got[0].involved_users == sorted(f"user{i}" for i in range(10))
    assert got[0].metadata == {"window_seconds": "60", "span_seconds": "9.0", "account_breached": "false", "status": "failure"}
    assert got[0].evidence[0].summary == "authentication_failure user=user9 host=ssh-server-01"


def test_success_after_a_spree_is_critical(make_events):
    rows = failures(6, user=lambda i: "root") + [
        {"at": 7, "event_type": "authentication_success", "status": "success", "source_ip": "203.0.113.9", "username": "root"}]
    got = fired(detect(make_events(rows), RuleParams(max_failures=5)), "RULE-001")
    last = got[-1]
    assert last.event_id == "e00006" and last.severity == "critical"
    assert last.metadata["account_breached"] == "true" and last.event_count_hint == 6
    assert last.confidence == round(min(0.99, 0.62 + 0.15), 2)
    assert last.description.endswith("A subsequent successful login was observed.")


def test_below_threshold_is_silent(make_events):
    assert detect(make_events(failures(5))).count() == 0


def test_missing_user_counts_but_is_not_listed(make_events):
    got = fired(detect(make_events(failures(10, user=lambda i: None)), enabled=["RULE-001"]), "RULE-001")
    assert len(got) == 1 and got[0].involved_users == []
    assert "targeting 1 distinct account(s)" in got[0].description
    assert got[0].evidence[0].summary == "authentication_failure user=None host=ssh-server-01"


def test_equal_timestamps_see_each_other(make_events):
    got = fired(detect(make_events(failures(10, step=0)), enabled=["RULE-001"]), "RULE-001")
    assert len(got) == 10 and {r.event_count_hint for r in got} == {10}


def test_window_is_open_at_its_old_end(make_events):
    rows = failures(9, step=0) + [{"at": 60, "event_type": "authentication_failure", "source_ip": "203.0.113.9", "username": "x"}]
    assert detect(make_events(rows), enabled=["RULE-001"]).count() == 0
    rows[-1]["at"] = 59.999999
    assert detect(make_events(rows), enabled=["RULE-001"]).count() == 1


def test_spray_counts_users_without_case(make_events):
    got = fired(detect(make_events(failures(10, user=lambda i: f"acct{i}"))), "RULE-002")
    assert [r.metadata["distinct_users"] for r in got] == ["8", "9", "10"]
    assert [r.confidence for r in got] == [0.55, 0.58, 0.61]
    assert detect(make_events(failures(10, user=lambda i: "Bob" if i % 2 else "bOB")), enabled=["RULE-002"]).count() == 0
    assert detect(make_events(failures(8, user=lambda i: "-" if i == 0 else f"a{i}")), enabled=["RULE-002"]).count() == 0


def test_port_scan(make_events):
    rows = [{"at": i * 0.5, "event_type": "firewall_deny", "status": "denied", "source_ip": "203.0.113.77",
             "destination_ip": "10.42.1.1", "destination_port": 1000 + i} for i in range(30)]
    got = fired(detect(make_events(rows)), "RULE-003")
    assert len(got) == 11
    first = got[0]
    assert first.metadata["unique_ports"] == "20" and first.affected_host == "10.42.1.1"
    assert first.metadata["ports_sample"] == "[" + ",".join(str(1000 + i) for i in range(20)) + "]"
    assert first.description == "203.0.113.77 contacted 20 unique destination ports in 10s (~2.1 ports/s, threshold 20/30s)."


def test_ports_are_listed_by_number(make_events):
    rows = [{"at": i, "event_type": "firewall_deny", "source_ip": "1.1.1.1", "destination_port": p}
            for i, p in enumerate([9, 80, 443, 8080, 10])]
    got = fired(detect(make_events(rows), RuleParams(unique_ports=5)), "RULE-003")
    assert got[0].metadata["ports_sample"] == "[9,10,80,443,8080]"
    assert got[0].affected_host == "ssh-server-01" and got[0].involved_hosts == []
    assert got[0].evidence[0].summary == "firewall_deny -> None:10"


def test_privilege_escalation(make_events):
    rows = [
        {"event_type": "privilege_escalation", "status": "success", "username": "bob", "action": "sudo su -",
         "source": "app-02", "metadata": {"user_role": "user"}},
        {"event_type": "application_event", "username": "alice", "action": "cache.refresh", "metadata": {"user_role": "admin"}},
        {"event_type": "application_event", "username": "carol", "message": "ran VISUDO now", "metadata": {"user_role": "admin"}},
        {"event_type": "application_event", "username": "dave", "action": "edit", "message": "sudo", "source_type": "identity"},
        {"event_type": "http_request", "source_type": "web_server", "username": "eve", "action": "GET /passwd"},
        {"event_type": "config_change", "username": "root", "action": "usermod x", "at": 11 * 3600, "status": "failure"},
    ]
    got = {r.event_id: r for r in fired(detect(make_events(rows)), "RULE-004")}
    assert set(got) == {"e00000", "e00005"}
    first = got["e00000"]
    assert first.confidence == 0.95 and first.severity == "high"
    assert first.correlation_key == "host:app-02:user:bob:privesc"
    assert first.description == (
        "User 'bob' performed administrative action 'sudo su -' on app-02. Actor 'bob' is not a known "
        "privileged account; host reported an explicit privilege-escalation event.")
    off = got["e00005"]
    assert off.confidence == 0.6 and off.metadata["actor_role"] == "unknown"
    assert off.metadata["reasons"] == '["action occurred outside business hours","the escalation attempt failed"]'


@pytest.mark.parametrize("query,labels", [
    ("SELECT * FROM users WHERE x='' OR 1=1 -- ", ["tautology injection (OR 1=1)", "unparameterised bulk read of a sensitive table"]),
    ("SELECT a FROM t UNION  SELECT password FROM admins", ["UNION-based injection"]),
    ("SELECT load_file('/etc/passwd')", ["file / command access"]),
    ("SELECT * FROM customers WHERE id = $1", []),
    ("SELECT id, name FROM users WHERE id = $1", []),
    ("SELECT * FROM app_users", []),
    ("x' -- ", ["inline comment truncation of a string literal"]),
    ("x'; drop table t", ["stacked-query injection"]),
    ("waitfor delay '0:0:5'", ["time-based blind injection"]),
])
def test_suspicious_sql(make_events, query, labels):
    rows = [{"event_type": "db_query", "source": "db-01", "username": "svc_api", "metadata": {"query": query}}]
    got = fired(detect(make_events(rows)), "RULE-005")
    assert [r.metadata["patterns"] for r in got] == (
        ['[' + ','.join(f'"{x}"' for x in labels) + ']'] if labels else [])


def test_large_result_fires_and_bad_counts_do_not(make_events):
    rows = [{"event_type": "db_query", "source_ip": "1.2.3.4", "metadata": {"query": "select 1", "rows_returned": n}}
            for n in ("5000", "4999", "many")]
    got = fired(detect(make_events(rows)), "RULE-005")
    assert len(got) == 1 and got[0].severity == "medium" and got[0].confidence == 0.55
    assert got[0].title == "Suspicious SQL from 1.2.3.4"
    assert got[0].correlation_key == "db:ssh-server-01:user:1.2.3.4:sqli"


def test_exfiltration_sums_per_destination(make_events):
    rows = [{"at": i, "event_type": "network_flow", "status": "allowed", "source_ip": "10.42.9.9",
             "destination_ip": "203.0.113.5", "destination_port": 443, "bytes_out": 2_000_000} for i in range(6)]
    rows.append({"at": 5, "event_type": "network_flow", "source_ip": "10.42.9.9", "destination_ip": "203.0.113.6", "bytes_out": 9_999_999})
    got = fired(detect(make_events(rows), RuleParams(bytes_threshold=10_000_000)), "RULE-006")
    assert [r.metadata["window_bytes"] for r in got] == ["10000000", "12000000"]
    assert got[0].severity == "medium" and got[0].confidence == 0.6 and got[0].event_count_hint == 1
    assert got[0].description == "9.5 MiB transferred from 10.42.9.9 to 203.0.113.5 within 60s (threshold 9.5 MiB)."
    assert got[0].evidence[0].summary == "1.9 MiB -> 203.0.113.5:443"


def test_every_account_is_listed(make_events):
    """80 accounts fail from one address: the firing names all of them."""
    events = make_events([{"at": i / 4, "event_type": "authentication_failure", "source_ip": "203.0.113.9", "username": f"u{i:02d}"} for i in range(80)])
    last = max(fired(detect(events), "RULE-001"), key=lambda r: r.event_count_hint)
    assert last.event_count_hint == 80 and last.involved_users == [f"u{i:02d}" for i in range(80)]


def test_exfiltration_confidence_rounds_the_binary_value(make_events):
    """62.5 MiB over 50 MiB is 0.625, a tie that goes to the even digit."""
    events = make_events([{"event_type": "network_flow", "source_ip": "10.0.0.1", "destination_ip": "8.8.8.8", "bytes_out": 65_536_000}])
    (hit,) = fired(detect(events, RuleParams(bytes_threshold=52_428_800)), "RULE-006")
    assert hit.confidence == 0.62


def test_auth_anomaly_counts_successes_only(make_events):
    def login(i, status="success"):
        return {"at": i, "event_type": "authentication_success", "status": status, "username": "Ann", "source_ip": f"198.51.100.{i}"}
    got = fired(detect(make_events([login(i) for i in range(6)])), "RULE-007")
    assert [(r.severity, r.confidence) for r in got] == [("medium", 0.5), ("medium", 0.6), ("high", 0.7)]
    assert got[0].correlation_key == "user:ann:authgeo"
    assert got[0].metadata["distinct_source_ips"] == '["198.51.100.0","198.51.100.1","198.51.100.2","198.51.100.3"]'
    assert detect(make_events([login(i, "failure") for i in range(6)]), enabled=["RULE-007"]).count() == 0


def test_switching_rules_off(make_events):
    events = make_events(failures(12))
    assert {r.rule_id for r in detect(events).select("rule_id").distinct().collect()} == {"RULE-001", "RULE-002"}
    assert detect(events, disabled=["RULE-001", "RULE-002"]).count() == 0
    assert detect(events, enabled=[]).count() == 0
    assert [r.rule_id for r in enabled_rules()] == [f"RULE-00{i}" for i in range(1, 8)]


def test_user_lists_against_brute_force(make_events):
    """One address owns most rows; lists and counts must match a direct evaluation."""
    rng = random.Random(7)
    rows = [{"at": rng.randrange(9000) / 8, "event_type": "authentication_failure",
             "source_ip": "9.9.9.9" if rng.random() < 0.7 else f"9.9.9.{rng.randrange(4)}",
             "username": f"u{rng.randrange(60):02d}"} for _ in range(500)]
    got = fired(detect(make_events(rows), RuleParams(max_failures=5, unique_users=4)), "RULE-001")
    want = {}
    for i, r in enumerate(rows):
        seen = [x for x in rows if x["source_ip"] == r["source_ip"] and r["at"] - 60 < x["at"] <= r["at"]]
        if len(seen) >= 5:
            users = sorted({x["username"] for x in seen})
            want[f"e{i:05d}"] = (len(seen), users)
    assert {r.event_id: (r.event_count_hint, r.involved_users) for r in got} == want
