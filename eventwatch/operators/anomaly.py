"""EWMA baselines and z-score anomalies.

The recurrence damps its own step by the current z-score, so each state depends on the last one
and no window sum expresses it. Series are sorted inside their partitions and walked once with a
three-number state. A series has one point per interval after the rollup, so its length follows
the time range, not the event volume; keys of many entities spread over the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import exact_round, fixed1
from ..schema import DETECTION

ALPHA = 0.3
Z_THRESHOLD = 3.5
MIN_SAMPLES = 20

STEP_FIELDS = ["mean", "var", "n", "z", "next_mean", "next_var"]


def ewma_steps(
    series: DataFrame, key: str = "metric", ts: str = "minute", value: str = "value",
    alpha: float = ALPHA, z_threshold: float = Z_THRESHOLD,
) -> DataFrame:
    """Each point with the baseline before it (mean, var, n, z) and after it (next_*)."""
    ordered = (
        series.select(F.col(key).cast("string").alias(key), F.col(ts).cast("bigint").alias(ts),
                      F.col(value).cast("double").alias(value))
        .repartition(key).sortWithinPartitions(key, ts)
    )
    columns = [key, ts, value, *STEP_FIELDS]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, mean, var, n = None, 0.0, 0.0, 0
        for pdf in batches:
            out = []
            for k, t, v in zip(pdf[key], pdf[ts], pdf[value], strict=True):
                if k != current:
                    current, mean, var, n = k, v, 0.0, 0
                std = math.sqrt(var)
                delta = v - mean
                z = 0.0 if std < 1e-9 else delta / std
                step = alpha / (1 + max(0.0, abs(z) - z_threshold))
                after_mean = mean + step * delta
                after_var = (1 - step) * (var + step * delta * delta)
                out.append((k, t, v, mean, var, n, z, after_mean, after_var))
                mean, var, n = after_mean, after_var, n + 1
            yield pd.DataFrame(out, columns=columns)

    schema = f"{key} string, {ts} bigint, {value} double, mean double, var double, n bigint, z double, next_mean double, next_var double"
    return ordered.mapInPandas(walk, schema)


def ewma_anomalies(
    series: DataFrame, key: str = "metric", ts: str = "minute", value: str = "value",
    alpha: float = ALPHA, z_threshold: float = Z_THRESHOLD, min_samples: int = MIN_SAMPLES,
) -> DataFrame:
    """Points that stray from a baseline of at least `min_samples` points, scored and explained."""
    s = ewma_steps(series, key, ts, value, alpha, z_threshold)
    over = F.abs("z") - z_threshold
    hit = s.filter((F.col("n") >= min_samples) & (F.abs("z") >= z_threshold)).select(
        key, ts, F.col(value).alias("v"), "mean", F.sqrt("var").alias("std"), "z", F.abs("z").alias("size"), "n",
        F.least(F.lit(1.0), 0.5 + 0.5 * (1 - F.exp(-(over * over) / 8.0))).alias("squashed"),
    )
    return hit.select(
        key, ts, exact_round("v", 3).alias("value"), exact_round("mean", 3).alias("baseline_mean"),
        exact_round("std", 3).alias("baseline_std"), exact_round("z", 2).alias("z_score"),
        exact_round("squashed", 3).alias("anomaly_score"),
        F.concat(
            F.col(key), F.lit(" = "), fixed1("v"), F.lit(" is "), fixed1("size"), F.lit("σ "),
            F.when(F.col("z") > 0, "above").otherwise("below"), F.lit(" the rolling baseline of "),
            fixed1("mean"), F.lit(" ± "), fixed1("std"), F.lit(" (n="), F.col("n").cast("string"), F.lit(")"),
        ).alias("anomaly_reason"),
        F.col("n").alias("samples"),
    )


def baselines(steps: DataFrame, key: str = "metric", ts: str = "minute", min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Current baseline of each series."""
    end = steps.groupBy(key).agg(
        F.max_by("next_mean", ts).alias("mean"), F.sqrt(F.max_by("next_var", ts)).alias("std"),
        F.max("n").alias("n"),
    )
    samples = F.col("n") + 1
    return end.select(
        key, exact_round("mean", 2).alias("mean"), exact_round("std", 2).alias("std"),
        samples.alias("samples"), (samples >= min_samples).alias("ready"),
    )


def _iso_minute(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def standalone(df: DataFrame, fields: dict[str, Column], kind: str, ts: str) -> DataFrame:
    """DETECTION rows for findings that no single event caused."""
    text = F.lit(None).cast("string")
    none = F.array()
    made = {
        "event_id": fields["correlation_key"], "detection_kind": F.lit(kind), "source_ip": text,
        "affected_host": text, "evidence": none, "involved_users": none, "involved_hosts": none,
        "event_count_hint": F.lit(1), "triggered_at": F.timestamp_seconds(ts), **fields,
    }
    return df.select(*[made[f.name].cast(f.dataType).alias(f.name) for f in DETECTION])


def anomaly_detections(anomalies: DataFrame, key: str = "metric", ts: str = "minute") -> DataFrame:
    """Anomalies as ANOM-001 detections."""
    c = F.col
    score = c("anomaly_score")
    anomalies = anomalies.withColumn("confidence", F.least(F.lit(0.95), score))
    pairs = [x for name in (key, "value", "baseline_mean", "baseline_std", "z_score")
             for x in (F.lit("metric" if name == key else name), c(name).cast("string"))]
    return standalone(anomalies, {
        "rule_id": F.lit("ANOM-001"),
        "title": F.concat(F.lit("Statistical anomaly: "), c(key)),
        "description": c("anomaly_reason"),
        "severity": F.when(score < 0.85, "medium").otherwise("high"),
        "confidence": exact_round("confidence", 2),
        "correlation_key": F.concat(F.lit("anomaly:"), c(key), F.lit(":"), _iso_minute(c(ts))),
        "recommended_action": F.lit(
            "Review what changed in the environment during this minute. Correlate with rule-based "
            "alerts and simulator activity."
        ),
        "anomaly_score": score,
        "metadata": F.create_map(*pairs),
    }, "anomaly", ts)


def anomaly_listing(alerts: DataFrame, limit: int = 30) -> DataFrame:
    """Recent anomaly and ML alerts with their deviation from the baseline."""
    kinds = [
        alerts.filter(F.col("detection_kind") == k).orderBy(F.desc("last_seen"), "alert_id").limit(limit)
        for k in ("anomaly", "ml")
    ]
    both = kinds[0].unionByName(kinds[1]).orderBy(F.desc("last_seen"), "alert_id").limit(limit)

    def number(name: str) -> Column:
        return F.coalesce(F.element_at("metadata", name).try_cast("double"), F.lit(0.0))

    now, base = number("value"), number("baseline_mean")
    both = both.withColumn("deviation", F.when(base > 0, (now - base) / base * 100))
    return both.select(
        "alert_id", "rule_id", F.element_at("metadata", "metric").alias("metric"),
        now.alias("current_value"), base.alias("baseline_mean"), number("baseline_std").alias("baseline_std"),
        number("z_score").alias("z_score"),
        exact_round("deviation", 1).alias("deviation_pct"),
        "severity", "confidence", "anomaly_score", "status", "first_seen", "last_seen", "description", "source_ip",
    )
