"""Baselines, anomalies, the forest and exact rounding."""

import math
import random

import pytest

from eventwatch.functions.text import exact_round, fixed0, fixed1, human_bytes
from eventwatch.operators.anomaly import anomaly_detections, baselines, ewma_anomalies, ewma_steps
from eventwatch.operators.forest import forest_detections, rolling_forest
from eventwatch.operators.rollup import METRICS, long_form, traffic_rollup
from pyspark.sql import functions as F


def series(spark, **named):
    rows = [(k, 60 * i, float(v)) for k, vs in named.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "metric string, minute bigint, value double").repartition(5)


def plain(values, alpha=0.3, thr=3.5, minimum=20):
    mean, var, n, hits = values[0], 0.0, 0, []
    for i, v in enumerate(values):
        std = math.sqrt(var)
        z = 0.0 if std < 1e-9 else (v - mean) / std
        if n >= minimum and abs(z) >= thr:
            hits.append((60 * i, round(v, 3), round(mean, 3), round(std, 3), round(z, 2)))
        a = alpha / (1 + max(0.0, abs(z) - thr))
        d = v - mean
        mean, var, n = mean + a * d, (1 - a) * (var + a * d * d), n + 1
    return mean, var, n, hits


def test_recurrence_equals_a_plain_loop(spark):
    rng = random.Random(1)
    data = {f"m{k}": [rng.gauss(100, 10) * (8 if rng.random() < 0.03 else 1) for _ in range(300)] for k in range(4)}
    s = series(spark, **data)
    got = {}
    for r in ewma_anomalies(s).collect():
        got.setdefault(r.metric, []).append((r.minute, r.value, r.baseline_mean, r.baseline_std, r.z_score))
    assert {k: sorted(v) for k, v in got.items()} == {k: plain(v)[3] for k, v in data.items() if plain(v)[3]}
    base = {r.metric: r for r in baselines(ewma_steps(s)).collect()}
    for k, v in data.items():
        mean, var, n, _ = plain(v)
        assert (base[k]["mean"], base[k]["std"], base[k].samples, base[k].ready) == (round(mean, 2), round(math.sqrt(var), 2), n, True)


def test_no_anomaly_before_enough_points(spark):
    assert ewma_anomalies(series(spark, m=[100.0] * 9 + [9000.0])).count() == 0


def test_spike_is_explained(spark):
    r = ewma_anomalies(series(spark, events_per_min=[100 + i % 7 for i in range(40)] + [5000]), z_threshold=3.0, min_samples=15).collect()
    assert len(r) == 1 and r[0].z_score > 3 and r[0].anomaly_score == 1.0
    assert r[0].anomaly_reason.startswith("events_per_min = 5000.0 is ") and "σ above the rolling baseline" in r[0].anomaly_reason
    d = anomaly_detections(ewma_anomalies(series(spark, events_per_min=[100 + i % 7 for i in range(40)] + [5000]))).first()
    assert d.rule_id == "ANOM-001" and d.severity == "high" and d.confidence == 0.95
    assert d.correlation_key == "anomaly:events_per_min:1970-01-01T00:40:00+00:00"


def test_stable_series_is_quiet(spark):
    assert ewma_anomalies(series(spark, m=[10 + i % 3 for i in range(60)]), min_samples=15).count() == 0


def test_rollup_skips_empty_minutes(make_events):
    rows = [{"at": t, "event_type": k, "source_ip": ip, "bytes_out": 1048576} for t, k, ip in
            ((0, "authentication_failure", "a"), (5, "db_error", "a"), (59, "firewall_deny", "b"), (180, "logout", None))]
    got = traffic_rollup(make_events(rows)).orderBy("minute").collect()
    assert [tuple(r[m] for m in METRICS) for r in got] == [(3, 1, 2, 3.0, 1, 1), (1, 0, 0, 1.0, 0, 0)]
    assert long_form(traffic_rollup(make_events(rows))).count() == 12


def test_forest_finds_the_odd_minutes(spark):
    rng = random.Random(4)
    rows = []
    for i in range(260):
        odd = i in (200, 231)
        rows.append((60 * i, *[float(rng.gauss(50, 3) * (6 if odd else 1)) for _ in METRICS]))
    df = spark.createDataFrame(rows, "minute bigint, " + ", ".join(f"{m} double" for m in METRICS))
    scored = {r.minute: r for r in rolling_forest(df, trees=40).collect()}
    assert len(scored) == 260 - 119 and min(scored) == 60 * 119
    assert scored[60 * 200].is_anomaly and scored[60 * 231].is_anomaly
    assert all(0 <= r.score <= 1 for r in scored.values())
    assert sum(r.is_anomaly for r in scored.values()) < 40
    assert {r.model for r in scored.values()} == {120, 150, 180, 210, 240}
    again = {r.minute: r.score for r in rolling_forest(df.repartition(7), trees=40).collect()}
    assert again == {k: r.score for k, r in scored.items()}
    d = [r for r in forest_detections(rolling_forest(df, trees=40)).collect() if r.correlation_key == "ml:1970-01-01T03:20:00+00:00"][0]
    assert d.rule_id == "ML-001" and d.severity == "medium" and d.confidence <= 0.9 and d.description.count("=") == 3


def test_forest_retrains_each_step_once_full(spark):
    rows = [(60 * i, *[float((i * 7 + j) % 11) for j in range(len(METRICS))]) for i in range(130)]
    df = spark.createDataFrame(rows, "minute bigint, " + ", ".join(f"{m} double" for m in METRICS))
    models = {r.minute // 60 + 1: r.model for r in rolling_forest(df, trees=5, sample=32, buffer=120).collect()}
    assert models == {n: (n if n >= 120 else max(60, n - n % 30)) for n in range(60, 131)}


@pytest.mark.parametrize("digits", [1, 2, 3])
def test_rounding_equals_python(spark, digits):
    rng = random.Random(digits)
    values = [k / 1000 for k in range(0, 2000)] + [rng.uniform(-50, 5000) for _ in range(500)] + [12.45, 0.575, 1.005, 2.5, -2.65]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", exact_round("v", digits).alias("r")).collect()
    assert [(r.v, r.r) for r in got if r.r != round(r.v, digits)] == []


def test_text_numbers_equal_python(spark):
    rng = random.Random(9)
    values = [k / 20 for k in range(200)] + [rng.uniform(0, 1e5) for _ in range(300)] + [0.5, 1.5, 2.5, 1.15, 1.25, 12.45]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed0(F.col("v")).alias("a"), fixed1("v").alias("b")).collect()
    assert [r for r in got if (r.a, r.b) != (f"{r.v:.0f}", f"{r.v:.1f}")] == []
    sizes = [0, 1, 1023, 1024, 1280, 1792, 52_428_800, 10 ** 7, 5 * 2 ** 40, 3 * 2 ** 50]
    got = spark.createDataFrame([(n,) for n in sizes], "n bigint").select(human_bytes("n").alias("t")).collect()
    assert [r.t for r in got] == ["0.0 B", "1.0 B", "1023.0 B", "1.0 KiB", "1.2 KiB", "1.8 KiB", "50.0 MiB", "9.5 MiB", "5.0 TiB", "3.0 PiB"]
