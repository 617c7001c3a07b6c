"""Field rules of the normaliser."""

import ipaddress
import json
import random
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from eventwatch.functions.ip import canonical_ip, is_internal
from eventwatch.functions.normalize import dedup, name_uuid, normalize

NOW = datetime(2026, 11, 1)


@pytest.fixture(scope="module")
def run(spark):
    def go(*payloads):
        texts = [p if isinstance(p, str) else json.dumps(p) for p in payloads]
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string").coalesce(1)
        valid, rejects = normalize(df, F.lit(NOW))
        return valid.collect(), {(r.reason, r.raw) for r in rejects.collect()}

    return go


def test_defaults_and_rejects(run):
    valid, rejects = run({"source": "web-01"}, "{broken", "[1]", {"timestamp": "not-a-date"}, {"timestamp": []}, {"timestamp": ""})
    assert len(valid) == 1
    e = valid[0]
    assert (e.event_type, e.severity, e.source, e.timestamp) == ("unknown", "info", "web-01", NOW)
    assert uuid.UUID(e.event_id).version == 5
    assert sorted(r for r, _ in rejects) == ["timestamp"] * 3 + ["undecodable"] * 2


@pytest.mark.parametrize("raw,want", [
    ("2026-09-07T12:00:00+02:00", datetime(2026, 9, 7, 10)),
    ("2026-09-07T12:00:00Z", datetime(2026, 9, 7, 12)),
    ("2026-09-07 12:00", datetime(2026, 9, 7, 12)),
    ("2026-09-07", datetime(2026, 9, 7)),
    ("20260907T120000.5", datetime(2026, 9, 7, 12, 0, 0, 500000)),
    (1_757_246_400, datetime(2025, 9, 7, 12)),
    (1_757_246_400.25, datetime(2025, 9, 7, 12, 0, 0, 250000)),
    ("2099-01-01T00:00:00", NOW), (None, NOW),
    ("2026-11-01T23:00:00", datetime(2026, 11, 1, 23)),
])
def test_timestamps(run, raw, want):
    assert run({"timestamp": raw})[0][0].timestamp == want


def test_ids(run, spark):
    valid, _ = run({"event_id": "abc"}, {"event_id": "{6BA7B811-9DAD-11D1-80B4-00C04FD430C8}"}, {"event_id": "", "source": "a"})
    assert valid[0].event_id == str(uuid.uuid5(uuid.NAMESPACE_URL, "abc"))
    assert valid[1].event_id == "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    names = [f"ид-{i}" for i in range(40)]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", name_uuid(F.col("n")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.n)) for r in got)


def test_numbers(run):
    valid, _ = run(*[{"destination_port": p} for p in (22, "443", 99999, "x", "-", -1)])
    assert [e.destination_port for e in valid] == [22, 443, None, None, None, None]
    valid, _ = run({"bytes_out": "-5", "bytes_in": "abc"}, {"bytes_out": 10 ** 30, "bytes_in": "17"}, {"bytes_out": 10 ** 45})
    assert [(e.bytes_out, e.bytes_in) for e in valid] == [(0, 0), (2 ** 63 - 1, 17), (2 ** 63 - 1, 0)]


def test_text_and_enums(run):
    valid, _ = run(
        {"event_type": "wat", "source_type": "toaster", "status": "??", "severity": "CRITICAL", "username": " \t "},
        {"event_type": "DB_Query", "source_type": "Firewall", "message": "A" * 9000, "source": "   "})
    a, b = valid
    assert (a.event_type, a.source_type, a.status, a.severity, a.username) == ("unknown", "unknown", "info", "critical", None)
    assert (b.event_type, b.source_type, b.status, len(b.message), b.source) == ("db_query", "firewall", None, 2048, "unknown")


def test_metadata(run):
    valid, _ = run(
        {"metadata": "notadict"}, {"metadata": {f"k{i}": i for i in range(200)}}, {"weird_field": "kept", "metadata": {"a": 1}},
        {"a": "outer", "metadata": {"a": "inner"}}, {"metadata": {"x" * 200 + "1": 1, "x" * 200 + "2": 2}},
        {"metadata": {"n": {"deep": [1, 2]}, "t": True}})
    m = [e.metadata for e in valid]
    assert m[0] == {} and len(m[1]) == 50 and m[1]["k49"] == "49"
    assert m[2] == {"a": "1", "weird_field": "kept"} and m[3] == {"a": "inner"}
    assert m[4] == {"x" * 128: "2"} and m[5] == {"n": '{"deep":[1,2]}', "t": "true"}


def test_hostile_text_is_stored_as_is(run):
    valid, rejects = run({"username": "admin'; DROP TABLE users; --", "source": "x\u0000y", "message": "line1\nline2\u0007"})
    assert not rejects and valid[0].username.startswith("admin'; DROP") and valid[0].source == "x\u0000y"


def test_addresses(spark):
    rng = random.Random(3)
    texts = ["10.0.0.1", "not-an-ip", "", "-", "999.1.1.1", "01.2.3.4", " 8.8.8.8 ", "::1", "::", "fe80::1%eth0", "1::2::3", ":1:2",
             ":::", "12345::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "64:ff9b::1.2.3.4", "2001:DB8:0:0:1:0:0:1", "g::1", "1:0:0:2:0:0:3:4",
             "2001:1::1", "2001:1::3", "fc00::1", "100::1", "2600::1", "192.0.0.9", "192.0.0.8", "203.0.113.7", "100.64.0.1", "224.0.0.1"]
    texts += [":".join("%x" % rng.choice([0, 0, 0, 1, rng.randrange(65536)]) for _ in range(8)) for _ in range(150)]
    texts += [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(150)]
    docs = [ipaddress.ip_network(n) for n in ("192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24")]

    def want(t):
        try:
            a = ipaddress.ip_address(t.strip())
        except ValueError:
            return None, None
        doc = a.version == 4 and any(a in n for n in docs)
        return str(a), not doc and (a.is_private or a.is_loopback or a.is_link_local)

    got = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("c", canonical_ip(F.col("t"))).withColumn(
        "p", is_internal(F.col("c"))).collect()
    assert [(r.t, r.c, r.p) for r in got if (r.c, r.p) != want(r.t)] == []


def test_duplicates_keep_the_earliest(make_events):
    rows = [{"event_id": "same", "at": t, "bytes_out": t} for t in (5, 3, 9)] + [{"event_id": "other", "at": 1}]
    got = {r.event_id: r.bytes_out for r in dedup(make_events(rows)).collect()}
    assert got == {"same": 3, "other": 0}
