"""Closed-form folding against a sequential fold."""

import random
from datetime import timedelta

import pytest

from fixtures import T0
from eventwatch.operators.correlate import correlate, merge_alerts
from eventwatch.schema import DETECTION, SEVERITIES


@pytest.fixture
def detections(spark):
    def make(rows):
        out = []
        for i, r in enumerate(rows):
            at = T0 + timedelta(seconds=r.get("at", i))
            full = {
                "event_id": f"e{i:04d}", "rule_id": "RULE-001", "detection_kind": "rule", "title": "t", "description": "d",
                "severity": "high", "confidence": 0.7, "correlation_key": "srcip:203.0.113.9", "source_ip": "203.0.113.9",
                "affected_host": "h", "recommended_action": "block", "evidence": [(f"e{i:04d}", at, f"s{i}")],
                "involved_users": ["root"], "involved_hosts": ["h"], "event_count_hint": 1, "metadata": {"i": str(i)},
                "triggered_at": at, **{k: v for k, v in r.items() if k != "at"},
            }
            out.append(tuple(full.get(f.name) for f in DETECTION))
        return spark.createDataFrame(out, DETECTION)

    return make


def test_hints_and_counts(detections):
    a = correlate(detections([{"event_count_hint": 11}, {"event_count_hint": 1, "confidence": 0.9}])).collect()
    assert len(a) == 1
    assert a[0].event_count == 12 and a[0].confidence == 0.9 and len(a[0].evidence) == 2 and a[0].status == "open"


def test_severity_only_rises(detections):
    a = correlate(detections([{}, {"severity": "critical", "title": "worse"}, {"severity": "medium", "title": "mild"}])).first()
    assert a.severity == "critical" and a.title == "worse" and a.metadata == {"i": "2"}


def test_keys_stay_apart(detections):
    assert correlate(detections([{"correlation_key": "a"}, {"correlation_key": "b"}])).count() == 2


def test_lists_are_capped(detections):
    rows = [{"involved_users": [f"u{i:03d}", f"u{99 - i:03d}"]} for i in range(80)]
    a = correlate(detections(rows)).first()
    assert [e.event_id for e in a.evidence] == [f"e{i:04d}" for i in range(55, 80)]
    assert a.involved_users == [f"u{i:03d}" for i in range(50)]


def sequential(rows):
    alerts = {}
    for i, r in sorted(enumerate(rows), key=lambda x: (x[1]["at"], x[0])):
        key = r["correlation_key"]
        a = alerts.get(key)
        h = r["event_count_hint"]
        if a is None:
            alerts[key] = {"n": max(1, h), "sev": r["severity"], "title": r["title"], "conf": r["confidence"],
                           "users": sorted(r["involved_users"])[:50], "ev": [f"e{i:04d}"], "first": r["at"], "last": r["at"], "meta": str(i)}
            continue
        a["n"] = max(a["n"] + 1, h)
        a["conf"] = max(a["conf"], r["confidence"])
        if SEVERITIES.index(r["severity"]) > SEVERITIES.index(a["sev"]):
            a["sev"], a["title"] = r["severity"], r["title"]
        a["users"] = sorted(set(a["users"]) | set(r["involved_users"]))[:50]
        a["ev"] = (a["ev"] + [f"e{i:04d}"])[-25:]
        a["last"], a["meta"] = r["at"], str(i)
    return alerts


def random_rows(seed, n=300):
    rng = random.Random(seed)
    return [{
        "at": rng.randrange(0, 20_000), "correlation_key": "hot" if rng.random() < 0.5 else f"k{rng.randrange(6)}",
        "event_count_hint": rng.choice([0, 1, 1, rng.randrange(200)]), "severity": rng.choice(SEVERITIES),
        "title": f"t{i}", "confidence": rng.randrange(100) / 100,
        "involved_users": sorted({f"u{rng.randrange(90):02d}" for _ in range(3)}),
    } for i, _ in enumerate(range(n))]


def view(alerts):
    return {r.correlation_key: {
        "n": r.event_count, "sev": r.severity, "title": r.title, "conf": r.confidence, "users": r.involved_users,
        "ev": [e.event_id for e in r.evidence], "first": int((r.first_seen.replace(tzinfo=T0.tzinfo) - T0).total_seconds()),
        "last": int((r.last_seen.replace(tzinfo=T0.tzinfo) - T0).total_seconds()), "meta": r.metadata["i"]} for r in alerts.collect()}


@pytest.mark.parametrize("chunk", [60, 3600, 1_000_000])
def test_fold_equals_the_sequential_fold(detections, chunk):
    rows = random_rows(chunk)
    assert view(correlate(detections(rows), chunk_seconds=chunk)) == sequential(rows)


def test_merging_batches_equals_folding_at_once(detections, spark):
    rows = random_rows(5)
    d = detections(rows)
    stored = correlate(d.filter(f"unix_seconds(triggered_at) < {int(T0.timestamp()) + 7000}"), store=False).drop("episode")
    mid = f"unix_seconds(triggered_at) >= {int(T0.timestamp()) + 7000}"
    changed = merge_alerts(stored, d.filter(mid))
    kept = stored.join(changed, "alert_id", "left_anti")
    assert view(changed.unionByName(kept)) == sequential(rows)


def test_closed_alerts_do_not_absorb(detections, spark):
    d = detections([{"at": t} for t in (1, 2, 5, 6, 9)])
    rows = [("RULE-001", "srcip:203.0.113.9", s, T0 + timedelta(seconds=t), f"r{t}") for s, t in
            (("resolved", 0), ("resolved", 3), ("false_positive", 4), ("resolved", 6), ("open", 7), ("resolved", 20))]
    triage = spark.createDataFrame(rows, "rule_id string, correlation_key string, status string, at timestamp, request_id string")
    got = sorted(correlate(d, triage, chunk_seconds=4).collect(), key=lambda r: r.episode)
    # closed at 3, closed again at 6 but reopened at 7 before the firing at 9
    assert [(r.event_count, r.status) for r in got] == [(2, "resolved"), (3, "resolved")]
    assert len({r.alert_id for r in got}) == 2


def test_active_states_reach_the_alert(detections, spark):
    """Acknowledged and investigating are kept while the alert is open and refused once it is closed."""
    d = detections([{"at": t} for t in (1, 10, 20)])
    rows = [("RULE-001", "srcip:203.0.113.9", s, T0 + timedelta(seconds=t), f"r{t}") for s, t in
            (("acknowledged", 2), ("resolved", 3), ("investigating", 4), ("acknowledged", 5), ("bogus", 6), ("investigating", 30))]
    triage = spark.createDataFrame(rows, "rule_id string, correlation_key string, status string, at timestamp, request_id string")
    for chunk in (3, 3600):
        got = {r.episode: (r.status, r.event_count) for r in correlate(d, triage, chunk).collect()}
        assert got == {1: ("resolved", 1), 2: ("investigating", 2)}


def test_merge_opens_a_new_alert_when_the_stored_one_is_closed(detections):
    stored = correlate(detections([{"at": 1}])).drop("episode").withColumn("status", __import__("pyspark").sql.functions.lit("resolved"))
    changed = merge_alerts(stored, detections([{"at": 2, "event_id": "z"}])).collect()
    assert len(changed) == 1 and changed[0].event_count == 1 and changed[0].alert_id != stored.first().alert_id


def test_only_shown_firings_are_read_in_full(spark, monkeypatch):
    """The fold numbers narrow rows; texts and evidence come from the firings an alert shows."""
    from eventwatch.operators import correlate as module
    from eventwatch.schema import DETECTION
    from eventwatch.session import materialize

    stored = {}

    def seen(df, name):
        stored[name] = materialize(df, name)
        return stored[name]

    monkeypatch.setattr(module, "materialize", seen)
    rows = []
    for i in range(300):
        full = {"event_id": f"e{i:03d}", "rule_id": "R", "correlation_key": f"k{i % 2}", "title": f"t{i}", "severity": "high" if i == 150 else "low",
                "confidence": 0.5, "event_count_hint": 1, "evidence": [(f"e{i:03d}", T0 + timedelta(seconds=i), "s")], "metadata": {"i": str(i)},
                "triggered_at": T0 + timedelta(seconds=i), "involved_users": [f"u{i}"], "involved_hosts": []}
        rows.append(tuple(full.get(f.name) for f in DETECTION))
    got = {r.correlation_key: r for r in module.correlate(spark.createDataFrame(rows, DETECTION)).collect()}
    assert stored["places"].count() <= 2 * (25 + 2)
    assert got["k0"].event_count == 150 and got["k0"].title == "t150" and got["k1"].title == "t1" and got["k0"].metadata["i"] == "298"
    assert [e.event_id for e in got["k1"].evidence] == [f"e{i:03d}" for i in range(251, 300, 2)]
