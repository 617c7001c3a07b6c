"""Continuous minute rollup and EWMA baselines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import exact_round
from ..operators.anomaly import ALPHA, STEP_FIELDS, Z_THRESHOLD

BASELINE_TTL_MS = 7 * 24 * 3600 * 1000


def stream_rollup(events: DataFrame, seconds: int = 60, lateness: str = "10 minutes") -> DataFrame:
    """The six traffic figures of each closed interval of a stream, as `rollup.traffic_rollup`.

    Two chained window aggregations keep the address count exact: per (interval, address) first,
    then per interval, so a busy address is one row per task and interval.
    """
    kind = F.col("event_type")
    width = f"{seconds} seconds"
    per_ip = events.withWatermark("timestamp", lateness).groupBy(
        F.window("timestamp", width).alias("w"), "source_ip"
    ).agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes_out").alias("bytes"),
        F.count_if(kind == "authentication_failure").alias("fail"),
        F.count_if(kind == "db_error").alias("err"), F.count_if(kind == "firewall_deny").alias("deny"),
    )
    total = per_ip.groupBy(F.window(F.window_time("w"), width).alias("w")).agg(
        F.sum("n").cast("double").alias("events_per_min"),
        F.sum("fail").cast("double").alias("auth_failures_per_min"),
        F.count("source_ip").cast("double").alias("unique_source_ips"),
        (F.sum("bytes") / F.lit(1024 * 1024)).alias("outbound_mib_per_min"),
        F.sum("err").cast("double").alias("db_errors_per_min"),
        F.sum("deny").cast("double").alias("firewall_denies_per_min"),
    )
    return total.withColumn("minute", F.unix_seconds("w.start")).withColumn(
        "outbound_mib_per_min", exact_round("outbound_mib_per_min", 3)
    ).drop("w")


class BaselineState(StatefulProcessor):
    """Mean, variance and count of one series, updated point by point in time order."""

    def __init__(self, alpha: float, z_threshold: float, ttl_ms: int | None) -> None:
        self.alpha, self.z_threshold, self.ttl_ms = alpha, z_threshold, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("baseline", "mean double, var double, n bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("minute")
        known = self.state.get() if self.state.exists() else None
        mean, var, n = known if known else (float(new["value"].iloc[0]), 0.0, 0)
        out = []
        for t, v in zip(new["minute"], new["value"], strict=True):
            std, delta = math.sqrt(var), v - mean
            z = 0.0 if std < 1e-9 else delta / std
            step = self.alpha / (1 + max(0.0, abs(z) - self.z_threshold))
            after = (mean + step * delta, (1 - step) * (var + step * delta * delta))
            out.append((key[0], t, v, mean, var, n, z, *after))
            mean, var, n = *after, n + 1
        self.state.update((float(mean), float(var), int(n)))
        yield pd.DataFrame(out, columns=["metric", "minute", "value", *STEP_FIELDS])

    def close(self) -> None:
        pass


def stream_ewma(
    series: DataFrame, alpha: float = ALPHA, z_threshold: float = Z_THRESHOLD, expire: bool = True
) -> DataFrame:
    """Streaming twin of `anomaly.ewma_steps` over (metric, minute, value) rows.

    With `expire`, a baseline not updated for seven days is forgotten. That needs processing time,
    under which a query never runs dry: use it with a periodic trigger, not with availableNow.
    """
    ttl, mode = (BASELINE_TTL_MS, "ProcessingTime") if expire else (None, "None")
    schema = ("metric string, minute bigint, value double, mean double, var double, n bigint, z double, "
              "next_mean double, next_var double")
    return series.groupBy("metric").transformWithStateInPandas(
        BaselineState(alpha, z_threshold, ttl), schema, "Append", mode)
