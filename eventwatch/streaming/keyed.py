"""Window rules with keyed state, for a stream that keeps no event table.

One state per (rule, entity): the contributions of the last window. A micro-batch's rows are
sorted before they are applied, rows at the same time see each other, and timers drop a state
once its window has passed. One entity's rows go through one task in order; where an entity can
carry a large share of the traffic use `streaming.engine`, which slices timelines.
"""

from __future__ import annotations

import bisect
from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.rules import WINDOW_RULES, RuleParams
from ..operators.sliding import contributions
from ..plans.detect import EVENT_FIELDS, as_detections, window_parts

GRACE_US = 30_000_000  # how long a state outlives its window
STATE = "us bigint, value string, amount bigint"
EXTRA = ["count", "amount", "n_distinct", "oldest", "members", "span", "rate"]


class WindowState(StatefulProcessor):
    """Applies one entity's rows in time order and emits those at or over the threshold."""

    def __init__(self, thresholds: dict[str, tuple[str, int, int]], columns: list[str]) -> None:
        self.thresholds = thresholds
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rule_id, _ = key
        measure, threshold, limit = self.thresholds[rule_id]
        new = pd.concat(list(rows)).sort_values("us", kind="stable")
        w_us = int(new["w_us"].iloc[0])
        stored = [tuple(r) for r in self.seen.get()] if self.seen.exists() else []
        adds = [
            (int(us), v, int(a))
            for us, v, n, a in zip(new["us"], new["value"], new["n"], new["amount"], strict=True) if n > 0
        ]
        rows_in_time = sorted(stored + adds, key=lambda r: r[0])
        following = iter(rows_in_time)
        row = next(following, None)
        alive: deque = deque()
        times: Counter = Counter()
        values: list[str] = []
        total = 0
        fired = []
        for t, group in new.groupby("us", sort=True):
            while row is not None and row[0] <= t:
                alive.append(row)
                total += row[2]
                if row[1] is not None:
                    if not times[row[1]]:
                        bisect.insort(values, row[1])
                    times[row[1]] += 1
                row = next(following, None)
            while alive and alive[0][0] <= t - w_us:
                _, value, amount = alive.popleft()
                total -= amount
                if value is not None:
                    times[value] -= 1
                    if not times[value]:
                        values.pop(bisect.bisect_left(values, value))
            facts = {"count": len(alive), "amount": total, "n_distinct": len(values)}
            if facts[measure] >= threshold:
                oldest = alive[0][0] if alive else int(t)
                span = (t - oldest) / 1e6
                hit = group.drop(columns=["value", "n", "amount", "w_us"]).copy()
                for name, fact in facts.items():
                    hit[name] = fact
                hit["oldest"], hit["span"], hit["rate"] = oldest, span, len(values) / max(span, 1.0)
                hit["members"] = [values[:limit]] * len(hit)
                fired.append(hit)
        newest = max([int(new["us"].iloc[-1])] + [r[0] for r in rows_in_time[-1:]])
        kept = [r for r in rows_in_time if r[0] > newest - w_us]
        if kept:
            self.seen.put(kept)
        else:
            self.seen.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((newest + w_us + GRACE_US) // 1000)
        if fired:
            yield pd.concat(fired)[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def keyed_detections(events: DataFrame, params: RuleParams | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Window-rule firings of a streaming SECURITY_EVENT frame as DETECTION rows.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass). Rows older than
    the watermark are dropped by Spark and counted in the query progress.
    """
    p = params or RuleParams()
    rules = WINDOW_RULES
    timed = events.withWatermark("timestamp", lateness).filter(
        F.col("event_type").isin(sorted({t for r in rules for t in r.types})))
    rows = contributions(timed, window_parts(rules, p), EVENT_FIELDS)
    out = rows.drop("w_us", "value", "n", "amount").schema
    columns = [f.name for f in out] + EXTRA
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + (
        ", count bigint, amount bigint, n_distinct bigint, oldest bigint, members array<string>, span double, rate double")
    thresholds = {r.rule_id: (r.measure, r.threshold(p), r.members) for r in rules}
    fired = rows.groupBy("rule_id", "entity").transformWithStateInPandas(
        WindowState(thresholds, columns), schema, "Append", "EventTime")
    return as_detections(fired, rules, p)
