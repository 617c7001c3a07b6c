"""Streaming results against the batch operators."""

import json
import re
from datetime import timedelta
from types import SimpleNamespace

from pyspark.sql import functions as F

from fixtures import T0
from eventwatch.operators.correlate import correlate
from eventwatch.operators.anomaly import ewma_steps
from eventwatch.operators.rollup import long_form, traffic_rollup
from eventwatch.operators.rules import WINDOW_RULES, RuleParams
from eventwatch.plans.dashboards import current_throughput, performance_history
from eventwatch.plans.detect import detect
from eventwatch.schema import AUDIT, SECURITY_EVENT
from eventwatch.operators import aggregates as agg
from eventwatch.session import materialize
from eventwatch.sources import tables
from eventwatch.sources.commits import Commits
from eventwatch.sources.tables import append_audit, append_events, read_audit, read_events, read_feed
from eventwatch.sources.topics import read_events as read_topic
from eventwatch.streaming.baselines import stream_ewma, stream_rollup
from eventwatch.streaming import engine as engine_module
from eventwatch.streaming.engine import Engine
from eventwatch.streaming.keyed import keyed_detections
from eventwatch.streaming.listener import Throughput, sample, source_lag


def attack(make_events, n=60):
    rows = []
    for i in range(n):
        rows.append({"at": i * 3, "event_type": "authentication_failure", "status": "failure", "source_ip": "203.0.113.9", "username": f"u{i % 12}"})
        rows.append({"at": i * 3, "event_type": "firewall_deny", "source_ip": "203.0.113.8", "destination_ip": "10.0.0.1", "destination_port": 20 + i % 30})
        rows.append({"at": i * 3 + 1, "event_type": "authentication_success", "status": "success", "source_ip": f"198.51.100.{i % 9}", "username": "ann"})
        rows.append({"at": i * 3 + 2, "event_type": "network_flow", "source_ip": "10.0.0.3", "destination_ip": "9.9.9.9", "bytes_out": 5_000_000})
    return make_events(rows)


PARAMS = RuleParams(unique_ports=8, authgeo_seconds=60)


def firings(df):
    return sorted((r.rule_id, r.event_id, r.description, r.confidence, tuple(r.involved_users), tuple(sorted(r.metadata.items())))
                  for r in df.collect())


def write_parts(events, path, parts=3, seconds=60):
    for i in range(parts):
        lo, hi = T0 + timedelta(seconds=i * seconds), T0 + timedelta(seconds=(i + 1) * seconds)
        events.filter((F.col("timestamp") >= F.lit(lo)) & (F.col("timestamp") < F.lit(hi))).coalesce(1).write.mode("append").parquet(path)


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def test_engine_equals_batch_and_survives_a_repeat(spark, make_events, tmp_path):
    events = attack(make_events)
    write_parts(events, str(tmp_path / "in"))
    engine = Engine(str(tmp_path / "out"), PARAMS)
    source = spark.readStream.schema(SECURITY_EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(engine.start(source, str(tmp_path / "cp"), availableNow=True))
    want = detect(events, PARAMS)
    names = want.columns
    got = engine.detections(spark).select(*names)
    assert firings(got) == firings(want)
    batch = {(r.rule_id, r.correlation_key): r.event_count for r in correlate(want).collect()}
    stored = engine.alerts(spark)
    assert {(r.rule_id, r.correlation_key): r.event_count for r in stored.collect()} == batch
    # the last batch again, as after a crash before its checkpoint
    again = events.filter(F.col("timestamp") >= F.lit(T0 + timedelta(seconds=120)))
    engine.step(again, 2)
    assert engine.events(spark).count() == events.count()
    stored = engine.alerts(spark)
    assert {(r.rule_id, r.correlation_key): r.event_count for r in stored.collect()} == batch
    # delivered once more under a new id: stored already, nothing changes
    engine.step(again, 3)
    assert engine.events(spark).count() == events.count()
    stored = engine.alerts(spark)
    assert {(r.rule_id, r.correlation_key): r.event_count for r in stored.collect()} == batch
    feed = read_feed(spark, engine.root)
    assert feed.filter("channel = 'events' and batch = 0").count() == 80


def test_an_event_id_is_stored_once_whatever_its_day(spark, make_events, tmp_path):
    """Copies on another day, in a later batch or in a retried one, add nothing."""
    root = str(tmp_path)
    first = make_events([{"event_id": "a"}, {"event_id": "b"}])
    later = make_events([{"event_id": "a", "at": 90_000}, {"event_id": "c", "at": 90_000}])
    commits = Commits(spark, root)
    stored, manifest = append_events(first, root, 0, commits.latest())
    assert stored.count() == 2 and read_events(spark, root).count() == 0
    commits.commit(0, manifest)
    for _ in range(2):
        stored, manifest = append_events(later, root, 1, commits.latest())
        assert [r.event_id for r in stored.collect()] == ["c"]
    commits.commit(1, manifest)
    assert sorted(r.event_id for r in read_events(spark, root).collect()) == ["a", "b", "c"]
    plan = agg.top_source_ips(read_events(spark, root), T0.replace(tzinfo=None))._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*event_date#\d+ >= ", plan)


def scanned(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def ids(spark, prefix, n):
    named = spark.range(n).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("event_id"))
    return named.withColumn("h", F.xxhash64("event_id"))


def test_a_lookup_of_ids_reads_what_the_batch_needs(spark, tmp_path):
    """Ten times the history costs no more rows; ids nobody stored are answered by the Bloom filters."""
    read = {}
    for n in (20_000, 200_000):
        index = tables.IdIndex(spark, str(tmp_path / str(n)), [])
        index.add(ids(spark, "x", n), n, 0)
        absent, present = ids(spark, "y", 20).collect(), ids(spark, "x", 20).collect()
        read[n] = scanned(index.probe([r.h for r in absent])), scanned(index.probe([r.h for r in present]))
        assert index.known(ids(spark, "x", 15).unionByName(ids(spark, "y", 15))).count() == 15
        assert index.known(ids(spark, "x", 1500).unionByName(ids(spark, "y", 15))).count() == 1500
    assert read[200_000][1] <= 20 * 500 and read[200_000][1] <= 1.5 * read[20_000][1] and read[200_000][0] < read[200_000][1]


def test_runs_of_ids_are_merged_level_by_level(spark, tmp_path):
    index = tables.IdIndex(spark, str(tmp_path), [])
    for batch in range(9):
        index.add(ids(spark, f"b{batch}-", 10), 10, batch)
    assert [(r["level"], r["rows"]) for r in index.runs] == [(1, 40), (1, 40), (0, 10)] and len(index.dropped) == 8
    assert all(index.known(ids(spark, f"b{b}-", 12)).count() == 10 for b in (0, 5, 8))


def held(engine, spark):
    return firings(engine.detections(spark)), sorted(
        (r.rule_id, r.correlation_key, r.alert_id, r.event_count, r.first_seen, r.last_seen, r.severity, tuple(r.involved_users), tuple(e.event_id for e in r.evidence))
        for r in engine.alerts(spark).collect())


def test_late_events_revise_firings_and_alerts(spark, make_events, tmp_path, monkeypatch):
    """Late rows add, change and take back firings; the tables equal the batch result."""
    monkeypatch.setattr(tables, "MAX_DELTAS", 2)
    events = attack(make_events, 40)
    number = F.substring("event_id", 2, 9).cast("int")
    late = {0: number % 7 != 3, 1: (number % 7 == 3) & (number % 2 == 0), 2: (number % 7 == 3) & (number % 2 == 1)}
    engine = Engine(str(tmp_path), PARAMS, feed=False)
    for batch, rows in late.items():
        engine.step(events.filter(rows), batch)
    want = detect(events, PARAMS)
    alerts = correlate(want)
    got = held(engine, spark)
    assert got[0] == firings(want)
    assert got[1] == sorted((r.rule_id, r.correlation_key, r.alert_id, r.event_count, r.first_seen, r.last_seen, r.severity, tuple(r.involved_users),
                             tuple(e.event_id for e in r.evidence)) for r in alerts.collect())
    changes = tables.read_changes(spark, engine.root)
    assert changes.filter("op = 'retract' and batch > 0").count() > 0 and changes.filter("op = 'retract' and batch = 0").count() == 0
    state = Commits(spark, engine.root).latest()["alerts"]
    assert any(s["base"] is not None for s in state.values()) and all(len(s["deltas"]) < 2 for s in state.values())


def test_texts_of_firings_are_neither_sorted_nor_written_twice(spark, make_events, tmp_path, monkeypatch):
    """Batches in order are read without a join, after retractions by a hash join; a retraction has no texts."""
    made = []

    def noted(df, name):
        made.append((name, df.columns))
        return materialize(df, name)

    monkeypatch.setattr(engine_module, "materialize", noted)
    events = attack(make_events, 30)
    number = F.substring("event_id", 2, 9).cast("int")
    engine = Engine(str(tmp_path), PARAMS, feed=False)
    engine.step(events.filter(number < 60), 0)
    engine.step(events.filter((number >= 60) & (number % 7 != 3)), 1)
    plan = engine.detections(spark)._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Exchange", "Sort", "Join"))
    assert not [name for name, columns in made if "description" in columns and "alert_id" not in columns]
    engine.step(events.filter((number >= 60) & (number % 7 == 3)), 2)
    assert not [name for name, columns in made if "description" in columns and "alert_id" not in columns]
    plan = engine.detections(spark)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan.replace("SortAggregate", "")
    changes = tables.read_changes(spark, engine.root)
    assert changes.filter("op = 'retract'").count() > 0 and changes.filter("op = 'retract' and description is not null").count() == 0
    assert firings(engine.detections(spark)) == firings(detect(events, PARAMS))


def test_a_late_event_completes_a_window(spark, make_events, tmp_path):
    """The firing belongs to the event that was stored before; one after the window changes nothing."""
    quiet = [{"event_id": f"q{i}", "at": i, "event_type": "authentication_success", "status": "success", "source_ip": f"198.51.100.{i}", "username": "bob"} for i in range(4)]
    engine = Engine(str(tmp_path), RuleParams(distinct_ips=4, authgeo_seconds=60), feed=False)
    engine.step(make_events(quiet[:3]), 0)
    assert engine.detections(spark).count() == 0
    engine.step(make_events([{**quiet[3], "at": -5}]), 1)
    assert [r.event_id for r in engine.detections(spark).collect()] == ["q2"]
    again = make_events([{"event_id": "q9", "at": 70, "event_type": "authentication_success", "status": "success", "source_ip": "198.51.100.9", "username": "bob"}])
    engine.step(again, 2)
    assert len(held(engine, spark)[1]) == 1


def test_analysts_moves_outlive_a_late_event(spark, make_events, tmp_path):
    """A resolved alert that is folded again stays resolved, with its history; firings after it open a new one."""
    row = lambda i, at: {"event_id": f"f{i:02d}", "at": at, "event_type": "authentication_failure", "status": "failure", "source_ip": "203.0.113.9", "username": "u"}
    engine = Engine(str(tmp_path), RuleParams(), feed=False)
    engine.step(make_events([row(i, i) for i in range(12)]), 0)
    manifest = Commits(spark, engine.root).latest()
    store = tables.AlertStore(spark, engine.root, manifest["alerts"])
    moved = F.array(F.struct(F.lit("open").alias("from"), F.lit("resolved").alias("to"), F.lit(T0 + timedelta(seconds=20)).alias("at"), F.lit("ann").alias("by")))
    store.write(store.read().withColumns({"status": F.lit("resolved"), "status_history": moved, "deleted": F.lit(False)}), 1)
    Commits(spark, engine.root).commit(1, {**manifest, "alerts": store.state})
    engine.step(make_events([row(20, 5.5), row(21, 30), row(22, 31)]), 2)
    got = sorted((r.status, r.event_count, len(r.status_history)) for r in engine.alerts(spark).collect())
    # 13 failures by 11 s; afterwards two firings that see 14 and 15
    assert got == [("open", 15, 0), ("resolved", 13, 1)]


def test_a_batch_is_visible_whole_or_not_at_all(spark, make_events, tmp_path):
    """A failure after each write leaves readers with the last commit; the retry, with the same clock, ends as if nothing had failed."""
    events = attack(make_events, 30)
    third = [F.substring("event_id", 2, 9).cast("int").between(a, a + 39) for a in (0, 40, 80)]
    clean = Engine(str(tmp_path / "clean"), PARAMS)
    broken = Engine(str(tmp_path / "broken"), PARAMS)
    points = [["events"], ["detections", "alerts"], ["feed"]]
    for batch, rows in enumerate(third):
        part = events.filter(rows)
        clean.step(part, batch)
        before = held(broken, spark) if batch else None
        for point in points[batch]:
            def fail(name):
                if name == point:
                    raise OSError(name)
            broken.written = fail
            try:
                broken.step(part, batch)
                raise AssertionError("did not fail")
            except OSError:
                pass
            if batch:
                assert held(broken, spark) == before
            assert broken.events(spark).count() == batch * 40 and read_feed(spark, broken.root).filter(F.col("batch") >= batch).count() == 0
        broken.written = None
        broken.step(part, batch)
    assert held(broken, spark) == held(clean, spark)
    commits = Commits(spark, broken.root)
    assert commits.begin(7, 5) == 5 and commits.begin(7, 9) == 5


def test_audit_of_a_retried_batch_is_kept_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x")], "actor string, action string")
    rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in AUDIT])
    for batch in (0, 1, 1):
        append_audit(rows, str(tmp_path / "audit"), batch)
    assert read_audit(spark, str(tmp_path / "audit")).count() == 2


def test_lag_is_summed_over_partitions():
    source = SimpleNamespace(latestOffset='{"t": {"0": 10, "1": 7}}', endOffset='{"t": {"0": 4, "1": 7}}', metrics={"maxOffsetsBehindLatest": "6"})
    other = SimpleNamespace(latestOffset="5", endOffset="3", metrics={"maxOffsetsBehindLatest": "2"})
    silent = SimpleNamespace(latestOffset=None, endOffset=None, metrics={})
    second = SimpleNamespace(latestOffset='{"t": {"0": 3, "2": 9}}', endOffset='{"t": {"0": 1}}', metrics={})
    assert source_lag(SimpleNamespace(sources=[source, second])) == 6 + 2 + 9
    assert source_lag(SimpleNamespace(sources=[other, silent])) == 2 and source_lag(SimpleNamespace(sources=[silent])) is None


def test_raw_stream_counts_faults(spark, tmp_path):
    rows = [{"event_id": f"x{i}", "event_type": "authentication_failure", "source_ip": "203.0.113.9", "username": f"u{i}",
             "timestamp": (T0 + timedelta(seconds=i)).isoformat()} for i in range(18)]
    lines = [json.dumps(r) for r in rows] + ["{oops", json.dumps(rows[0]), json.dumps({"timestamp": "never"})]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join(lines))
    clock = iter(range(0, 1000, 6))
    meter = Throughput(every=5, clock=lambda: next(clock))
    engine = Engine(str(tmp_path / "out"), throughput=meter)
    run(engine.start(read_topic(spark, "text", str(tmp_path / "in")), str(tmp_path / "cp"), raw=True, availableNow=True))
    assert engine.events(spark).count() == 18
    alerts = engine.alerts(spark).collect()
    assert sorted((a.rule_id, a.event_count) for a in alerts) == [("RULE-001", 18), ("RULE-002", 18)]
    reasons = spark.read.parquet(str(tmp_path / "out/rejects")).groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in reasons} == {"undecodable": 1, "timestamp": 1}
    last = meter.history[-1]
    assert last[6] == 2 and last[7] == 1 and last[9] == round((1 - 2 / 21) * 100, 2)


def test_keyed_state_equals_batch(spark, make_events, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = attack(make_events)
    write_parts(events, str(tmp_path / "in"))
    source = spark.readStream.schema(SECURITY_EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = keyed_detections(source, PARAMS)
    run(out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start())
    want = detect(events, PARAMS, enabled=[r.rule_id for r in WINDOW_RULES])
    assert firings(spark.read.schema(want.schema).parquet(str(tmp_path / "out"))) == firings(want)


def test_samples_and_freshness(spark):
    meter = Throughput()
    for i in range(300):
        meter.history.append(sample({"ingested": 100 + i, "persisted": 90, "alerts": 1}, 5.0, 0.2, T0.timestamp() + 5 * i))
    s = meter.samples(spark)
    h = performance_history(s).collect()
    assert len(h) == 241 and h[0].updated_at < h[-1].updated_at
    end = (T0 + timedelta(seconds=5 * 299)).replace(tzinfo=None)
    fresh = current_throughput(s, end + timedelta(seconds=10)).first()
    stale = current_throughput(s, end + timedelta(seconds=25)).first()
    assert fresh.worker_online and fresh.events_per_second == round(399 / 5, 2)
    assert not stale.worker_online and stale.events_per_second is None


def test_rollup_and_baselines_on_a_stream(spark, make_events, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = attack(make_events)
    write_parts(events, str(tmp_path / "in"))
    source = spark.readStream.schema(SECURITY_EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rolled = stream_rollup(source, 10, "0 seconds")
    run(rolled.writeStream.format("parquet").option("path", str(tmp_path / "roll")).option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start())
    got = {r.minute: r.asDict() for r in spark.read.schema(rolled.schema).parquet(str(tmp_path / "roll")).collect()}
    want = {r.minute: r.asDict() for r in traffic_rollup(events, 10).collect()}
    assert len(got) >= len(want) - 2 and all(got[k] == want[k] for k in got)

    long = long_form(traffic_rollup(events, 10))
    cut = int(T0.timestamp()) + 90
    for part in (long.filter(F.col("minute") < cut), long.filter(F.col("minute") >= cut)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "series"))
    points = spark.readStream.schema(long.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "series"))
    steps = stream_ewma(points, expire=False)
    run(steps.writeStream.format("parquet").option("path", str(tmp_path / "steps")).option("checkpointLocation", str(tmp_path / "cp2"))
        .trigger(availableNow=True).start())
    got = sorted(tuple(r) for r in spark.read.schema(steps.schema).parquet(str(tmp_path / "steps")).collect())
    assert got == sorted(tuple(r) for r in ewma_steps(long).collect())
