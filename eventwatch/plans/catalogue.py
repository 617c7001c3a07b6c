"""Rule catalogue: contents, upkeep and activity."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.aggregates import rule_activity
from ..operators.anomaly import ALPHA, MIN_SAMPLES, Z_THRESHOLD
from ..operators.rules import RULES, Rule, RuleParams

ANOM = Rule(
    "ANOM-001", "TRAFFIC_ANOMALY", "Statistical traffic anomaly (EWMA z-score)", "anomaly", "medium", (),
    "Investigate what changed in the environment during the flagged minute.",
    "Flags per-minute metrics that deviate beyond the configured z-score from a rolling "
    "exponentially-weighted baseline.", kind="anomaly",
    params=lambda p: {"zscore_threshold": Z_THRESHOLD, "ewma_alpha": ALPHA, "min_samples": MIN_SAMPLES},
)
FOREST = Rule(
    "ML-001", "ISOLATION_FOREST", "Isolation Forest outlier (optional)", "anomaly", "medium", (),
    "Confirm with deterministic rules before acting.",
    "Unsupervised outlier detection on per-minute feature vectors. Research/demo model; never "
    "overrides a deterministic rule.", kind="ml",
)
SCHEMA = (
    "rule_id string, handle string, name string, category string, default_severity string, kind string, "
    "enabled boolean, description string, mitre_attack array<string>, parameters string, recommended_action string"
)


def catalogue(spark: SparkSession, params: RuleParams | None = None, disabled: tuple[str, ...] = ("ML-001",)) -> DataFrame:
    """The nine rules; parameters as JSON text."""
    p = params or RuleParams()
    rows = [
        (r.rule_id, r.handle, r.name, r.category, r.severity, r.kind, r.rule_id not in disabled,
         r.summary, list(r.mitre), json.dumps(r.params(p)), r.action)
        for r in [*RULES, ANOM, FOREST]
    ]
    return spark.createDataFrame(rows, SCHEMA)


def upsert_catalogue(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or update by rule_id; an existing rule keeps its `enabled` switch."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.rule_id") == F.col("n.rule_id"), "full_outer")
    return both.select(*[
        (F.coalesce("o.enabled", "n.enabled") if c == "enabled" else F.coalesce(f"n.{c}", f"o.{c}")).alias(c)
        for c in old.columns
    ])


def with_activity(rules: DataFrame, alerts: DataFrame) -> DataFrame:
    """Catalogue with trigger counts; zero for rules that never fired."""
    seen = rule_activity(alerts)
    zero = F.lit(0).cast("bigint")
    return rules.join(seen, "rule_id", "left").withColumns({
        "trigger_count": F.coalesce("trigger_count", zero), "active_count": F.coalesce("active_count", zero),
    })


def find_rule(rules: DataFrame, name: str) -> DataFrame:
    """Rule by id or handle, case ignored."""
    want = name.lower()
    return rules.filter((F.lower("rule_id") == want) | (F.lower("handle") == want))


def catalogue_totals(active: DataFrame) -> DataFrame:
    return active.agg(F.count(F.lit(1)).alias("count"), F.sum("trigger_count").alias("total_triggers"))
