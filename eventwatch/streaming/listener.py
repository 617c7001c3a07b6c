"""Throughput samples of a running stream."""

from __future__ import annotations

import json
import time
from collections import deque
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from ..plans.dashboards import HISTORY

SAMPLE_SCHEMA = (
    "updated_at timestamp, heartbeat_at timestamp, events_per_second double, events_processed_per_second double, "
    "pipeline_latency_ms double, alerts_per_minute double, invalid_events_window bigint, "
    "duplicate_events_window bigint, batches_window bigint, pipeline_health_pct double, window_seconds double, "
    "source_lag bigint"
)


def source_lag(progress) -> int | None:
    """Records the sources still hold, summed over all their partitions; None when they do not say.

    The offsets of each partition are compared where a source reports them (topic -> partition ->
    offset); otherwise its largest partition lag has to do.
    """
    known: list[int] = []
    for s in progress.sources:
        latest, end = _offsets(s.latestOffset), _offsets(s.endOffset)
        if latest is not None and end is not None:
            known.append(sum(max(0, n - end.get(part, 0)) for part, n in latest.items()))
        elif s.metrics and s.metrics.get("maxOffsetsBehindLatest") is not None:
            known.append(max(0, int(float(s.metrics["maxOffsetsBehindLatest"]))))
    return sum(known) if known else None


def _offsets(text: str | None) -> dict[tuple[str, str], int] | None:
    """{(topic, partition): offset} of an offset's JSON text, None for another form of offset."""
    try:
        topics = json.loads(text or "")
        return {(t, p): int(n) for t, parts in topics.items() for p, n in parts.items()}
    except (ValueError, AttributeError, TypeError):
        return None


def sample(counts: dict[str, float], elapsed: float, busy_seconds: float, at: float, lag: int | None = None) -> tuple:
    """One history row from the counts of a window of `elapsed` seconds."""
    ingested, persisted = counts.get("ingested", 0), counts.get("persisted", 0)
    invalid = counts.get("invalid", 0)
    when = datetime.fromtimestamp(at, timezone.utc)
    return (
        when, when, round(ingested / elapsed, 2), round(persisted / elapsed, 2),
        round(busy_seconds / max(persisted, 1) * 1000, 3), round(counts.get("alerts", 0) / elapsed * 60, 2),
        int(invalid), int(counts.get("duplicate", 0)), int(max(counts.get("batches", 0), 1)),
        round(max(0.0, 1 - invalid / max(ingested, 1)) * 100, 2), round(elapsed, 1), lag,
    )


class Throughput(StreamingQueryListener):
    """Gathers micro-batch counts and closes a sample about every `every` seconds.

    `report` is called by the engine with its counts after each batch; the progress events add the
    source lag and the busy time. The history keeps the newest 241 samples.
    """

    def __init__(self, every: float = 5.0, clock=time.time) -> None:
        self.every, self.clock = every, clock
        self.history: deque[tuple] = deque(maxlen=HISTORY)
        self.lag: int | None = None
        self._reset()

    def _reset(self) -> None:
        self.counts: dict[str, float] = {}
        self.busy = 0.0
        self.started = self.clock()

    def report(self, counts: dict[str, float], busy_seconds: float = 0.0) -> None:
        for name, n in {**counts, "batches": 1}.items():
            self.counts[name] = self.counts.get(name, 0) + n
        self.busy += busy_seconds
        now = self.clock()
        if now - self.started >= self.every:
            self.history.append(sample(self.counts, now - self.started, self.busy, now, self.lag))
            self._reset()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.lag = source_lag(event.progress)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def samples(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.history), SAMPLE_SCHEMA)
