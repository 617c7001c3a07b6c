"""Continuous detection: one foreachBatch step from raw events to stored alerts.

A micro-batch is normalised, stored, detected and folded with the batch operators. Window rules
see the stored events around the batch, read by day, so no rule state lives outside the event table
and a restart needs only the checkpoint.

Late events (S6) re-open what they touch: stored events whose windows they enter are measured again,
firings that changed are retracted and emitted anew in the detection changelog, and alerts of those keys are
folded again from the firings that hold. After any order of arrival the tables equal the batch result.

All tables of a batch become visible by one rename (`sources.commits`); a batch that is delivered
again after its commit does nothing, one that failed before it starts over with the same clock.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window as W, functions as F

from ..functions.normalize import normalize
from ..operators.correlate import correlate, merge_alerts
from ..operators.rules import WINDOW_RULES, Rule, RuleParams, WindowRule
from ..operators.sliding import SLICE, contributions
from ..plans.detect import as_detections, enabled_rules, matches, window_parts
from ..schema import ALERT, DETECTION, SECURITY_EVENT
from ..session import materialize, scratch
from ..sources import tables
from ..sources.commits import Commits
from ..sources.tables import EMIT, KEY, RETRACT, AlertStore, names
from .listener import Throughput

#: What the fold reads of every firing; texts and evidence it reads of the few an alert shows.
FOLDED = ["rule_id", "correlation_key", "triggered_at", "event_id", "event_count_hint", "severity", "confidence", "anomaly_score",
          "involved_users", "involved_hosts", "batch"]


@dataclass
class Engine:
    """Where the stream stores its tables and which rules it runs."""

    root: str
    params: RuleParams = field(default_factory=RuleParams)
    disabled: tuple[str, ...] = ()
    chunk_seconds: int = 3600
    feed: bool = True
    throughput: Throughput | None = None
    #: Told the name of each table when a batch has written it, before the commit.
    written: Callable[[str], None] | None = None

    def events(self, spark: SparkSession) -> DataFrame:
        return tables.read_events(spark, self.root)

    def detections(self, spark: SparkSession) -> DataFrame:
        """Firings that hold after the last committed batch."""
        return tables.current_detections(tables.read_changes(spark, self.root))

    def alerts(self, spark: SparkSession) -> DataFrame:
        return tables.read_alerts(spark, self.root)

    def _wrote(self, name: str) -> None:
        if self.written:
            self.written(name)

    def _windowed(self) -> list[WindowRule]:
        return [r for r in enabled_rules(disabled=self.disabled) if r in WINDOW_RULES]

    def _days(self, stored: DataFrame, seconds_before: int, seconds_after: int) -> list[date]:
        """Days that hold events around those of the batch."""
        first, last = timedelta(seconds=seconds_before), timedelta(seconds=seconds_after)
        found: set[date] = set()
        spans = stored.groupBy("event_date").agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")).collect()
        for r in spans:
            day, end = (r.lo - first).date(), (r.hi + last).date()
            while day <= end:
                found.add(day)
                day += timedelta(days=1)
        return sorted(found)

    def _told(self, rows: DataFrame, rules: list[Rule]) -> DataFrame:
        """Matches as emitted firings. They are dealt by day before their texts are made, so only measures are shuffled."""
        dealt = rows.withColumn("day", F.to_date("timestamp")).hint("rebalance", "day")
        return as_detections(dealt, rules, self.params, ("content",)).withColumn("op", F.lit(EMIT))

    def changes(self, stored: DataFrame, batch_id: int, high_us: int | None) -> DataFrame:
        """DETECTION rows with `content` and `op`: what the batch's events fire, and what late ones among them revise."""
        spark = stored.sparkSession
        low = stored.agg(F.min(F.unix_micros("timestamp"))).first()[0]
        if low is None or not enabled_rules(disabled=self.disabled):
            return spark.createDataFrame([], DETECTION).withColumns({"content": F.lit(0).cast("bigint"), "op": F.lit(EMIT)})
        rules = self._windowed()
        reach = max((r.seconds(self.params) for r in rules), default=0)
        late = high_us is not None and low <= high_us and bool(rules)
        # a late row re-opens slices that end up to SLICE + 1 windows after it
        days = self._days(stored, reach, reach * (SLICE + 1) if late else 0)
        around = tables.read_events(spark, self.root, batch_id, days)
        if not late:
            start = F.timestamp_micros(F.lit(low - reach * 1_000_000))
            found = matches(around.filter(F.col("timestamp") > start), self.params, enabled_rules(disabled=self.disabled), F.col("batch") == batch_id)
            return reduce(DataFrame.unionByName, [self._told(*f) for f in found])
        touched = materialize(self._touched(around, stored, rules, batch_id, high_us), "touched")
        marked = around.join(touched.withColumn("touched", F.lit(True)), "event_id", "left").withColumn(
            "due", (F.col("batch") == batch_id) | F.col("touched").isNotNull())
        marked = materialize(marked, "reopened")
        found = [(materialize(rows, "found"), kind)
                 for rows, kind in matches(marked, self.params, enabled_rules(disabled=self.disabled), F.col("due"))]
        key = ["rule_id", "event_id", "content"]
        before = tables.live_changes(tables.read_changes(spark, self.root, batch_id - 1, days), [*key, "correlation_key", "triggered_at"])
        before = materialize(before.join(touched, "event_id", "left_semi"), "before")
        same = before.select(*key).join(reduce(DataFrame.unionByName, [rows.select(*key) for rows, _ in found]), key).select("rule_id", "event_id")
        same = materialize(same, "unchanged")
        kept = ["rule_id", "event_id", "content", "correlation_key", "triggered_at"]
        out = [self._told(rows.join(same, ["rule_id", "event_id"], "left_anti"), kind) for rows, kind in found]
        gone = before.join(same, ["rule_id", "event_id"], "left_anti").withColumn("day", F.to_date("triggered_at")).hint("rebalance", "day")
        gone = gone.select(*[(F.col(f.name) if f.name in kept else F.lit(None)).cast(f.dataType).alias(f.name) for f in DETECTION],
                           "content", F.lit(RETRACT).alias("op"))
        return reduce(DataFrame.unionByName, out, gone)

    def _touched(self, around: DataFrame, stored: DataFrame, rules: list[WindowRule], batch_id: int, high_us: int) -> DataFrame:
        """event_id of earlier events in a slice that a late event of the batch adds to, from its time on."""
        parts = window_parts(rules, self.params)
        length = F.col("w_us") * SLICE

        def start(us: Column) -> Column:
            return us - F.pmod(us, length)

        late = contributions(stored.filter(F.unix_micros("timestamp") <= high_us), parts).filter("n > 0")
        hit = F.array_distinct(F.array(start(F.col("us")), start(F.col("us") + F.col("w_us") - 1)))
        slices = late.select("rule_id", "entity", F.explode(hit).alias("slice"), "us").groupBy("rule_id", "entity", "slice").agg(
            F.min("us").alias("since"))
        earlier = contributions(around.filter(F.col("batch") < batch_id), parts, ["event_id"]).select(
            "event_id", "rule_id", "entity", "us", start(F.col("us")).alias("slice"))
        return earlier.join(slices, ["rule_id", "entity", "slice"]).filter("us >= since").select("event_id").distinct()

    def changed_alerts(self, found: DataFrame, known: DataFrame, touched: list[int], batch_id: int) -> DataFrame:
        """ALERT rows the batch creates, changes or takes back (`deleted`).

        Firings after all others of their key are merged into the stored alert; a key with a retraction or
        an earlier firing is folded again from all firings of it that hold. `known` are the alerts of the
        `touched` buckets.
        """
        spark = found.sparkSession
        seen = known.groupBy(*KEY).agg(F.max("last_seen").alias("seen"))
        first = found.groupBy(*KEY).agg(F.max(F.col("op") == RETRACT).alias("back"), F.min("triggered_at").alias("first"))
        revised = materialize(first.join(seen, KEY, "left").filter(
            F.col("back") | F.coalesce(F.col("first") <= F.col("seen"), F.lit(False))).select(*KEY), "revised-keys")
        # `found` is a table: each branch of the fold reads the columns it needs
        ahead = found.join(revised, KEY, "left_anti").select(*names(DETECTION))
        merged = merge_alerts(known, ahead, self.chunk_seconds).withColumn("deleted", F.lit(False))
        if revised.isEmpty():
            return merged
        history = tables.read_changes(spark, self.root, batch_id).filter(F.col("bucket").isin(touched)).join(revised, KEY, "left_semi")
        hold = materialize(tables.live_changes(history, FOLDED), "firings")
        whole = history.filter(F.col("op") == EMIT).select(*names(DETECTION), "batch")
        old = materialize(known.join(revised, KEY, "left_semi"), "revised-alerts")
        moves = old.select(*KEY, F.inline("status_history")).select(
            *KEY, F.col("to").alias("status"), "at", F.lit(None).cast("string").alias("request_id"))
        folded = correlate(hold, None if moves.isEmpty() else moves, self.chunk_seconds, store=False, whole=whole).drop("episode")
        folded = materialize(folded.withColumn("ahead", F.lead("first_seen").over(W.partitionBy(*KEY).orderBy("first_seen"))), "folded")
        # an analyst's moves stay with the episode they fall into, whose first event may be another now
        told = old.select(*KEY, F.explode("status_history").alias("move")).join(folded.select(*KEY, "alert_id", "first_seen", "ahead"), KEY).filter(
            (F.col("move.at") >= F.col("first_seen")) & (F.col("ahead").isNull() | (F.col("move.at") < F.col("ahead"))))
        by_time = F.transform(F.array_sort(F.collect_list(F.struct(F.col("move.at").alias("k"), "move"))), lambda m: m["move"])
        told = told.groupBy("alert_id").agg(by_time.alias("told"))
        again = folded.join(told, "alert_id", "left").withColumn(
            "status_history", F.coalesce("told", "status_history")).select(*names(ALERT), F.lit(False).alias("deleted"))
        again = materialize(again, "folded-again")
        gone = old.join(again, "alert_id", "left_anti").select(*names(ALERT), F.lit(True).alias("deleted"))
        return merged.unionByName(again).unionByName(gone)

    def step(self, events: DataFrame, batch_id: int) -> int:
        """Store, detect, fold and commit one micro-batch of SECURITY_EVENT rows. Returns new alerts if sampled."""
        spark = events.sparkSession
        commits = Commits(spark, self.root)
        manifest = commits.latest()
        if batch_id <= manifest["batch"]:
            return 0
        with scratch(spark):
            return self._commit(events, batch_id, {**manifest, "dropped": []}, commits)

    def _commit(self, events: DataFrame, batch_id: int, manifest: dict, commits: Commits) -> int:
        spark, high = events.sparkSession, manifest["high_us"]
        stored, manifest = tables.append_events(events.select(*names(SECURITY_EVENT)), self.root, batch_id, manifest)
        self._wrote("events")
        found = tables.write_detections(self.changes(stored, batch_id, high), self.root, batch_id)
        self._wrote("detections")
        store = AlertStore(spark, self.root, manifest["alerts"])
        touched = [r.bucket for r in found.select("bucket").distinct().collect()]
        known = store.read(touched)
        changed = materialize(self.changed_alerts(found, known, touched, batch_id), "changed-alerts")
        new = changed.join(known.select("alert_id"), "alert_id", "left_anti").count() if self.throughput else 0
        store.write(changed, batch_id)
        self._wrote("alerts")
        if self.feed:
            tables.write_feed(stored, changed.filter(~F.col("deleted")), self.root, batch_id)
            self._wrote("feed")
        top = stored.agg(F.max(F.unix_micros("timestamp"))).first()[0]
        commits.commit(batch_id, {
            **manifest, "alerts": store.state, "dropped": [*manifest["dropped"], *store.dropped],
            "high_us": max((x for x in (high, top) if x is not None), default=None)})
        return new

    def raw_step(self, raw: DataFrame, batch_id: int, now: Column | None = None) -> dict[str, int]:
        """As `step` for raw JSON rows; rejects are stored with their reason. Returns counts."""
        began = time.perf_counter()
        spark = raw.sparkSession
        commits = Commits(spark, self.root)
        if batch_id <= commits.latest()["batch"]:
            return {}
        with scratch(spark):
            return self._raw(raw, batch_id, F.timestamp_micros(F.lit(commits.begin(batch_id))) if now is None else now, began)

    def _raw(self, raw: DataFrame, batch_id: int, now: Column, began: float) -> dict[str, int]:
        spark, seen = raw.sparkSession, Observation()
        valid, rejects = normalize(raw.observe(seen, F.count(F.lit(1)).alias("ingested")), now)
        valid = materialize(valid, "normalized")
        rejects.write.mode("overwrite").parquet(f"{self.root}/rejects/batch={batch_id}")
        self._wrote("rejects")
        alerts = self.step(valid, batch_id)
        count = {"ingested": seen.get["ingested"], "valid": valid.count()}
        count["persisted"] = self.events(spark).filter(F.col("batch") == batch_id).count()
        count["invalid"] = count["ingested"] - count["valid"]
        count["duplicate"] = count["valid"] - count["persisted"]
        if self.throughput:
            self.throughput.report({**count, "alerts": alerts}, time.perf_counter() - began)
        return count

    def start(self, source: DataFrame, checkpoint: str, raw: bool = False, **trigger):
        """Run continuously; the checkpoint advances only after a batch is stored."""
        run = self.raw_step if raw else self.step
        writer = source.writeStream.foreachBatch(lambda df, i: run(df, i) and None).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()
