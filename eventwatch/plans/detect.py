"""Run the rules over events and return one row per firing.

All window rules share one aggregation, one window shuffle and one join back to the events; the
pattern rules are a projection with a filter. Nothing depends on how many rules are enabled.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.rules import (
    PATTERN_RULES, RULES, WINDOW_RULES, Rule, RuleParams, WindowRule, event_micros,
)
from ..operators.sliding import contributions, firing_members, part, sweep
from ..schema import DETECTION
from ..session import spread

EVENT_FIELDS = [
    "event_id", "timestamp", "source", "event_type", "source_ip", "destination_ip",
    "destination_port", "username", "status", "bytes_out",
]


def enabled_rules(enabled: Iterable[str] | None = None, disabled: Iterable[str] = ()) -> list[Rule]:
    """The rules to run, in catalogue order."""
    off = set(disabled)
    keep = None if enabled is None else set(enabled)
    return [r for r in RULES if r.rule_id not in off and (keep is None or r.rule_id in keep)]


def window_parts(rules: list[WindowRule], p: RuleParams) -> list[Column]:
    return [
        part(
            F.col("event_type").isin(*r.types) & r.applies(), r.rule_id, r.seconds(p), r.entity(), event_micros(),
            r.value() if r.value else None,
            F.when(r.contributes(), 1).otherwise(0) if r.contributes else 1,
            r.amount() if r.amount else 0,
        )
        for r in rules
    ]


def _per_rule(rules: list[Rule], pick) -> Column:
    out = None
    for r in rules:
        cond = F.col("rule_id") == r.rule_id
        out = F.when(cond, pick(r)) if out is None else out.when(cond, pick(r))
    return out


def as_detections(df: DataFrame, rules: list[Rule], p: RuleParams, keep: tuple[str, ...] = ()) -> DataFrame:
    """Events with `rule_id` and the measures their rule reads, as DETECTION rows; `keep`: further columns."""
    reads = {r.rule_id: r.reads(p) for r in rules}

    def of(name: str) -> Column:
        return _per_rule(rules, lambda r: reads[r.rule_id][name])

    evidence = F.array(F.struct("event_id", "timestamp", of("summary").alias("summary")))
    made = df.select(
        "event_id", "rule_id", F.lit("rule").alias("detection_kind"),
        of("title").alias("title"), of("description").alias("description"),
        of("severity").alias("severity"), of("confidence").alias("confidence"),
        of("correlation_key").alias("correlation_key"), "source_ip",
        of("affected_host").alias("affected_host"),
        _per_rule(rules, lambda r: F.lit(r.action)).alias("recommended_action"),
        evidence.alias("evidence"),
        of("involved_users").alias("involved_users"), of("involved_hosts").alias("involved_hosts"),
        of("event_count_hint").alias("event_count_hint"),
        F.lit(None).cast("double").alias("anomaly_score"),
        of("metadata").alias("metadata"), F.col("timestamp").alias("triggered_at"), *keep,
    )
    return made.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in DETECTION], *keep)


def window_firings(
    events: DataFrame, rules: list[WindowRule], p: RuleParams, only: Column | None = None
) -> DataFrame:
    """Events that fire a window rule, with the measures and visible values at their time."""
    # reaches the scan, so other events are not read
    events = events.filter(F.col("event_type").isin(sorted({t for r in rules for t in r.types})))
    parts = window_parts(rules, p)
    swept = sweep(contributions(events, parts), distinct=any(r.value for r in rules))
    fires = _per_rule(rules, lambda r: F.col(r.measure) >= F.lit(r.threshold(p)))
    fired = firing_members(swept, F.coalesce(fires, F.lit(False)), {r.rule_id: r.members for r in rules})
    wanted = events if only is None else events.filter(only)
    mine = contributions(wanted, parts, EVENT_FIELDS).drop("w_us", "value", "n", "amount")
    span = (F.col("us") - F.col("oldest")) / 1e6
    timed = fired.withColumn("span", span).withColumn("rate", F.col("n_distinct") / F.greatest(span, F.lit(1.0)))
    keys = ["rule_id", "entity", "us"]
    return spread(mine, *keys).join(spread(timed, *keys), keys)


def matches(
    events: DataFrame, p: RuleParams, rules: list[Rule], only: Column | None = None
) -> list[tuple[DataFrame, list[Rule]]]:
    """What fires, before any text is made: per kind of rule, rows for `as_detections` and the rules they are of.

    `content` tells two firings of one rule and event apart: it covers the parameters and the measures the rule reads.
    """
    windowed = [r for r in rules if r in WINDOW_RULES]
    patterned = [r for r in rules if r in PATTERN_RULES]
    stated = F.lit(repr(p))
    out: list[tuple[DataFrame, list[Rule]]] = []
    if windowed:
        counted = F.when(~F.col("rule_id").isin([r.rule_id for r in windowed if not r.counted]), F.col("count"))
        content = F.xxhash64(
            stated, F.coalesce(counted, F.lit(-1)), "oldest", "n_distinct", "amount", F.coalesce(F.size("members"), F.lit(-1)), "members")
        out.append((window_firings(events, windowed, p, only).withColumn("content", content), windowed))
    if patterned:
        ids = F.array(*[F.when(r.applies(p), F.lit(r.rule_id)) for r in patterned])
        asked = events if only is None else events.filter(only)
        hit = asked.withColumn("rule_id", F.explode(F.array_compact(ids)))
        out.append((hit.withColumn("content", F.xxhash64(stated)), patterned))
    return out


def detect(
    events: DataFrame, params: RuleParams | None = None, enabled: Iterable[str] | None = None,
    disabled: Iterable[str] = (), only: Column | None = None,
) -> DataFrame:
    """All firings of the enabled rules as DETECTION rows.

    With `only`, firings of those events alone; the other events still count in the windows.
    """
    p = params or RuleParams()
    out = [as_detections(rows, rules, p) for rows, rules in matches(events, p, enabled_rules(enabled, disabled), only)]
    if not out:
        return events.sparkSession.createDataFrame([], DETECTION)
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result
