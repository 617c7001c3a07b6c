"""Sliding measures against direct evaluation."""

import random

import pytest
from pyspark.sql import functions as F

from eventwatch.operators.sliding import contributions, part, sliding, sweep


def measure(spark, rows, seconds, **kw):
    df = spark.createDataFrame(rows, "e string, us bigint, v string, a bigint, c boolean")
    out = sliding(df, F.col("e"), seconds, us=F.col("us"), value=F.col("v"), amount=F.col("a"), **kw)
    return {(r.entity, r.us): (r["count"], r.amount, r.n_distinct, r.oldest) for r in out.collect()}


def test_counts_uniques_and_span(spark):
    rows = [("1.2.3.4", i * 1_000_000, f"user{i % 2}", 1000, True) for i in range(5)]
    assert measure(spark, rows, 60)[("1.2.3.4", 4_000_000)] == (5, 5000, 2, 0)


def test_old_entries_leave(spark):
    rows = [("e", 0, "a", 1, True), ("e", 100_000_000, "b", 1, True)]
    assert measure(spark, rows, 10)[("e", 100_000_000)] == (1, 1, 1, 100_000_000)


def test_probe_does_not_add(spark):
    rows = [("e", 0, "x", 1, True), ("e", 5_000_000, "y", 0, False), ("e", 6_000_000, "y", 1, True)]
    got = measure(spark, rows, 60, contributes=F.col("c"))
    assert got[("e", 5_000_000)][:3] == (1, 1, 1) and got[("e", 6_000_000)][:3] == (2, 2, 2)


@pytest.mark.parametrize("seed,span,tick", [(1, 400, 1), (2, 2000, 10), (3, 120, 5), (4, 5000, 1)])
def test_random_series(spark, seed, span, tick):
    """Ties, a hot entity and many slices; times reach before 1970."""
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        e = "hot" if rng.random() < 0.6 else f"e{rng.randrange(5)}"
        us = rng.randrange(-span // tick, span // tick) * tick * 1_000_000
        adds = rng.random() < 0.85
        rows.append((e, us, f"v{rng.randrange(8)}", rng.randrange(1, 100) if adds else 0, adds))
    w = 30
    got = measure(spark, rows, w, contributes=F.col("c"))
    assert set(got) == {(r[0], r[1]) for r in rows}
    for (e, us), (count, amount, distinct, oldest) in got.items():
        seen = [r for r in rows if r[0] == e and us - w * 1_000_000 < r[1] <= us and r[4]]
        assert (count, amount, distinct) == (len(seen), sum(r[3] for r in seen), len({r[2] for r in seen}))
        if seen:
            assert oldest == min(r[1] for r in seen)


def test_slices_are_not_merged_by_their_compressed_size(spark, make_events):
    """Rows that repeat each other are small in a shuffle and large in a sort: every partition stays a task of its own."""
    events = make_events([{"at": t, "event_type": "authentication_failure", "source_ip": f"10.0.0.{t % 40}", "username": "u"} for t in range(400)])
    parts = [part(F.lit(True), "r", 60, F.col("source_ip"), F.unix_micros("timestamp"), F.col("username"))]
    swept = sweep(contributions(events, parts)).withColumn("task", F.spark_partition_id())
    assert swept.select("task").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
