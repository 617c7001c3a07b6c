"""Isolation forest over per-minute vectors.

Rolling use: point n (counting from 1) is scored by a forest trained on the points before it
inside a buffer of `BUFFER`. A forest is trained at each multiple of 30 until the buffer is full
and at every point afterwards, and serves until the next. Points and training rows are grouped by
forest, so forests are built in parallel and a group never exceeds BUFFER + 30 rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.text import exact_round
from ..session import materialize
from .anomaly import _iso_minute, standalone
from .correlate import carried
from .rollup import METRICS

# Buffer length, retraining step, trees, rows per tree,
# expected share of outliers, seed.
BUFFER = 720
RETRAIN = 30
TREES = 100
SAMPLE = 256
CONTAMINATION = 0.05
SEED = 42


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    big = np.where(n > 2, n, 3.0)
    deep = 2 * (np.log(big - 1) + np.euler_gamma) - 2 * (big - 1) / big
    return np.where(n > 2, deep, np.where(n == 2, 1.0, 0.0))


def _tree_depths(rng, train: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Grow one random tree on `train` and return the path length of each of `points`."""
    limit = int(np.ceil(np.log2(max(len(train), 2))))
    depth = np.zeros(len(points))
    work = [(train, np.arange(len(points)), 0)]
    while work:
        rows, idx, level = work.pop()
        lo, hi = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
        usable = np.flatnonzero(hi > lo)
        if level >= limit or len(rows) <= 1 or not len(usable):
            depth[idx] += level + _average_path(np.array([len(rows)]))[0]
            continue
        f = rng.choice(usable)
        cut = rng.uniform(lo[f], hi[f])
        left_rows, left_points = rows[:, f] <= cut, points[idx, f] <= cut
        work.append((rows[left_rows], idx[left_points], level + 1))
        work.append((rows[~left_rows], idx[~left_points], level + 1))
    return depth


def _scores(train: np.ndarray, points: np.ndarray, seed: int, trees: int, sample: int) -> np.ndarray:
    """Score in (0, 1) per point; higher is more unusual."""
    rng = np.random.default_rng(seed)
    size = min(sample, len(train))
    total = np.zeros(len(points))
    for _ in range(trees):
        total += _tree_depths(rng, train[rng.choice(len(train), size, replace=False)], points)
    return 2.0 ** (-total / trees / max(_average_path(np.array([size]))[0], 1e-9))


def rolling_forest(
    vectors: DataFrame, columns: list[str] = METRICS, ts: str = "minute", trees: int = TREES,
    sample: int = SAMPLE, contamination: float = CONTAMINATION, buffer: int = BUFFER,
) -> DataFrame:
    """Score every point after the warm-up: ts, columns, score, is_anomaly, model."""
    warmup = max(60, buffer // 6)
    one = vectors.select(F.col(ts).cast("bigint").alias(ts), *[F.coalesce(c, F.lit(0.0)).cast("double").alias(c) for c in columns])
    # one row per interval, read four times below: the rollup behind it runs once
    one = materialize(one, "vectors")
    day = 86_400
    numbered = carried(
        one.withColumn("chunk", F.col(ts) - F.pmod(F.col(ts), F.lit(day))).withColumn("series", F.lit(0)),
        ["series"], [ts], {"n": F.lit(1).cast("bigint")},
    ).drop("chunk", "series")
    n = F.col("n")
    # forest that scores point n; in the growing phase the first one appears at the warm-up
    model = F.when(n >= buffer, n).when(n >= warmup, F.greatest(n - n % RETRAIN, F.lit(warmup)))
    scored = numbered.filter(n >= warmup).withColumn("model", model).withColumn("role", F.lit(1))
    models = F.filter(
        F.sequence(F.greatest(n + 1, F.lit(warmup)), F.greatest(n + buffer - 1, F.lit(warmup))),
        lambda m: (m >= buffer) | (m % RETRAIN == 0) | (m == warmup),
    )
    train = numbered.withColumn("model", F.explode(models)).withColumn("role", F.lit(0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data, asked = pdf[pdf["role"] == 0].sort_values("n"), pdf[pdf["role"] == 1].sort_values("n")
        if asked.empty or len(data) < 2:
            return pd.DataFrame({c: pd.Series(dtype="object") for c in [ts, *columns, "score", "is_anomaly", "model"]})
        fit, points = data[columns].to_numpy(float), asked[columns].to_numpy(float)
        both = -_scores(fit, np.vstack([fit, points]), SEED, trees, sample)
        offset = np.percentile(both[: len(fit)], 100 * contamination)
        margin = both[len(fit):] - offset
        out = asked[[ts, *columns, "model"]].copy()
        out["score"] = np.round(np.clip(0.5 - margin, 0, 1), 3)
        out["is_anomaly"] = margin < 0
        return out[[ts, *columns, "score", "is_anomaly", "model"]]

    schema = f"{ts} bigint, " + ", ".join(f"{c} double" for c in columns) + ", score double, is_anomaly boolean, model bigint"
    both = train.unionByName(scored)
    return both.groupBy("model").applyInPandas(run, schema)


def forest_detections(scored: DataFrame, columns: list[str] = METRICS, ts: str = "minute") -> DataFrame:
    """Outliers as ML-001 detections; names the three largest features."""
    pairs = F.array(*[F.struct((-F.col(c)).alias("v"), F.lit(c).alias("k")) for c in columns])
    top = F.transform(
        F.slice(F.array_sort(pairs), 1, 3), lambda s: F.concat(s["k"], F.lit("="), F.format_string("%.1f", -s["v"]))
    )
    scored = scored.withColumn("confidence", F.least(F.lit(0.9), F.col("score")))
    features = F.to_json(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))]))
    return standalone(scored.filter("is_anomaly"), {
        "rule_id": F.lit("ML-001"),
        "title": F.lit("Isolation Forest flagged an anomalous minute"),
        "description": F.concat(
            F.lit("Isolation Forest flagged this minute as an outlier; largest contributors: "), F.array_join(top, ", ")
        ),
        "severity": F.lit("medium"),
        "confidence": exact_round("confidence", 2),
        "correlation_key": F.concat(F.lit("ml:"), _iso_minute(F.col(ts))),
        "recommended_action": F.lit(
            "Demo/research model. Treat as a hint to inspect this minute's traffic mix; confirm with "
            "deterministic rules before acting."
        ),
        "anomaly_score": F.col("score"),
        "metadata": F.create_map(F.lit("features"), features, F.lit("model"), F.lit("IsolationForest")),
    }, "ml", ts)
