"""Fold detections into alerts (F1-F6) and merge batches into stored alerts.

One alert per (rule_id, correlation_key) and episode; an episode ends when the alert is resolved
or marked a false positive, and the next firing opens a new one. Every alert field has a closed
form over the ordered firings, so folding is aggregation, not iteration: counting one per firing
but never below a firing's hint gives, for firings i = 1..n with hints h_i,

    event_count = n + max(h_i - i).

A key may hold a large share of all firings, so its timeline is cut into chunks of fixed length.
Positions, last rows and sums are first taken per (key, chunk) and then carried over the few
chunk rows of each key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..schema import (
    ACTIVE_STATUSES, ALERT, MAX_EVIDENCE, MAX_INVOLVED, TERMINAL_STATUSES, micros, severity_rank,
)
from ..session import materialize, spread

KEY = ["rule_id", "correlation_key"]
EPISODE = [*KEY, "episode"]
CHUNK_SECONDS = 3600


def chunk_of(us: Column, seconds: int) -> Column:
    width = seconds * 1_000_000
    return us - F.pmod(us, F.lit(width).cast("bigint"))


def carried(
    df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None,
    lags: dict[str, str] | None = None,
) -> DataFrame:
    """Running sums and previous non-null values over `keys` by `order`, as new columns.

    `df` has a `chunk` column that leads the order. The scan runs inside (keys, chunk); what each
    chunk hands on is taken from one row per chunk. `df` is read twice, so it should be a table
    or a cheap plan.
    """
    sums, lags = sums or {}, lags or {}
    place = F.struct(*order)
    ends = df.groupBy(*keys, "chunk").agg(
        *[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"_l_{n}") for n, c in lags.items()],
    )
    by_chunk = W.partitionBy(*keys).orderBy("chunk")
    before = by_chunk.rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select(
        *keys, "chunk",
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums],
        *[F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_l_{n}") for n in lags],
    )
    inside = W.partitionBy(*keys, "chunk").orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    ahead = inside.rowsBetween(W.unboundedPreceding, -1)
    return spread(df, *keys, "chunk").join(carry, [*keys, "chunk"]).select(
        *df.columns,
        *[(F.col(f"_s_{n}") + F.sum(c).over(upto)).alias(n) for n, c in sums.items()],
        *[F.coalesce(F.last(c, ignorenulls=True).over(ahead), F.col(f"_l_{n}")).alias(n) for n, c in lags.items()],
    )


def split_episodes(detections: DataFrame, triage: DataFrame | None, chunk_seconds: int = CHUNK_SECONDS):
    """Number the episodes of each key (F2). Returns (firings, effective triage rows), numbered.

    The firings come with their measures only: texts and lists are not shuffled for the numbers.

    `triage` has rule_id, correlation_key, status, at. A firing opens a new episode when the last
    firing, terminal action or "open" before it on the key's timeline is a terminal action. The
    other active states change the alert only while it is not closed; a status outside the five
    is ignored. At equal times the firing comes first.
    """
    d = detections.select(
        *KEY, micros(F.col("triggered_at")).alias("us"), "event_id", "event_count_hint", severity_rank(F.col("severity")).alias("rank"),
        "confidence", "anomaly_score")
    if triage is None:
        return d.withColumn("episode", F.lit(1).cast("bigint")), None
    steps = d.select(
        *KEY, "us", F.lit(0).alias("kind"), F.col("event_id").alias("tie"), F.lit(False).alias("ends"),
        F.lit(None).cast("string").alias("status"),
    ).unionByName(
        triage.filter(F.col("status").isin(*TERMINAL_STATUSES, *ACTIVE_STATUSES)).select(
            *KEY, micros(F.col("at")).alias("us"), F.lit(1).alias("kind"),
            F.coalesce(F.col("request_id"), F.lit("")).alias("tie"),
            F.when(F.col("status").isin(*TERMINAL_STATUSES, "open"), F.col("status").isin(TERMINAL_STATUSES)).alias("ends"),
            "status",
        )
    ).withColumn("chunk", chunk_of(F.col("us"), chunk_seconds))
    order = ["us", "kind", "tie"]
    steps = materialize(carried(steps, KEY, order, lags={"ended": "ends"}), "steps")
    opens = F.when((F.col("kind") == 0) & F.coalesce(F.col("ended"), F.lit(True)), 1).otherwise(0)
    steps = carried(steps, KEY, order, sums={"episode": opens})
    numbered = d.join(
        steps.filter("kind = 0").select(*KEY, "us", F.col("tie").alias("event_id"), "episode"),
        [*KEY, "us", "event_id"],
    )
    # on a closed alert only "open" changes anything
    effective = steps.filter((F.col("kind") == 1) & (F.col("episode") > 0) & ((F.col("status") == "open") | ~F.col("ended")))
    return numbered, effective.select(*EPISODE, "us", "tie", "status")


def _smallest(df: DataFrame, columns: list[str], keys: list[str], limit: int) -> DataFrame:
    """The `limit` smallest distinct elements of each array column per key, sorted."""
    def tag(c: str) -> Column:
        return F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(F.lit(c).alias("of"), x.alias("item")))

    tagged = F.flatten(F.array(*[tag(c) for c in columns]))
    items = df.select(*keys, F.inline(tagged)).filter("item is not null").distinct()
    rank = F.row_number().over(W.partitionBy(*keys, "of").orderBy("item"))
    return items.withColumn("_r", rank).filter(F.col("_r") <= limit).groupBy(*keys).agg(*[
        F.array_sort(F.collect_list(F.when(F.col("of") == c, F.col("item")))).alias(c) for c in columns])


def _told(detections: DataFrame, places: DataFrame, at: list[str]) -> DataFrame:
    """What the first, last and worst firing of each episode say, and its last MAX_EVIDENCE evidence items, oldest first.

    `places` has EPISODE and the columns `at` of the firings to read, and `times`, how often one is numbered (null: no evidence).
    """
    order = F.struct("us", "event_id")
    copies = F.count(F.lit(1)).over(W.partitionBy(*EPISODE, "us", "event_id"))
    read = detections.withColumn("us", micros(F.col("triggered_at"))).join(places, at).withColumn(
        "times", (F.col("times") / copies).cast("int"))
    items = F.array_sort(F.collect_list(F.when(F.col("times").isNotNull(), F.struct("us", "event_id", "evidence", "times"))))
    last = F.flatten(F.transform("items", lambda e: F.array_repeat(e["evidence"], e["times"])))
    return read.groupBy(*EPISODE).agg(
        F.min_by(F.struct("source_ip", "affected_host", "recommended_action", "detection_kind"), order).alias("first"),
        F.max_by("metadata", order).alias("metadata"),
        F.min_by(F.struct("title", "description", "severity"), F.struct(-severity_rank(F.col("severity")), "us", "event_id")).alias("top"),
        items.alias("items"),
    ).withColumn("items", last).withColumn(
        "evidence", F.flatten(F.slice("items", F.greatest(F.size("items") - (MAX_EVIDENCE - 1), F.lit(1)), MAX_EVIDENCE)))


def fold(
    detections: DataFrame, numbered: DataFrame, chunk_seconds: int = CHUNK_SECONDS, split: bool = False,
    whole: DataFrame | None = None,
) -> DataFrame:
    """One row per episode: alert fields plus `firings` (n) and `lift` (max of h_i - i).

    Counts and places come from the measures in `numbered`; of the `detections` only the firings an alert shows are read
    in full. Both are read several times. Without `split`, all firings of a key are its first episode.

    `whole` has the whole rows where `detections` are without texts; firings in it may be older versions, so that both
    have `batch`, which tells the one that counts.
    """
    df = spread(numbered.withColumn("chunk", chunk_of(F.col("us"), chunk_seconds)), *EPISODE, "chunk")
    order = F.struct("us", "event_id")
    place = F.row_number().over(W.partitionBy(*EPISODE, "chunk").orderBy("us", "event_id"))
    per_chunk = df.withColumn("i", place).groupBy(*EPISODE, "chunk").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.greatest(F.col("event_count_hint"), F.lit(1)) - F.col("i")).alias("lift"),
        F.max("confidence").alias("confidence"),
        F.max("anomaly_score").alias("anomaly_score"),
        F.min(order).alias("first"),
        F.max("us").alias("last_us"),
        F.min(F.struct(-F.col("rank"), F.col("us"), F.col("event_id"))).alias("top"),
    )
    before = W.partitionBy(*EPISODE).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    body = per_chunk.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).groupBy(*EPISODE).agg(
        F.sum("n").alias("firings"),
        F.max(F.col("lift") - F.col("before")).alias("lift"),
        F.max("confidence").alias("confidence"),
        F.max("anomaly_score").alias("anomaly_score"),
        F.min("first").alias("first"),
        F.max("last_us").alias("last_us"),
        F.min("top").alias("top"),
    )
    body = materialize(body.select(
        *EPISODE, "firings", "lift", "confidence", "anomaly_score", F.col("first.us").alias("first_us"),
        F.col("first.event_id").alias("first_event"), "last_us", F.col("top.us").alias("top_us"), F.col("top.event_id").alias("top_event"),
    ), "bodies")
    newest = F.rank().over(W.partitionBy(*EPISODE).orderBy(F.desc("us"), F.desc("event_id")))
    places = numbered.select(*EPISODE, "us", "event_id").withColumn("_r", newest).filter(F.col("_r") <= MAX_EVIDENCE).groupBy(
        *EPISODE, "us", "event_id").agg(F.count(F.lit(1)).alias("times"))
    for at in ("first", "top"):
        places = places.unionByName(body.select(
            *EPISODE, F.col(f"{at}_us").alias("us"), F.col(f"{at}_event").alias("event_id"), F.lit(None).cast("bigint").alias("times")))
    # a written table has a known size: Spark only shuffles the detections for this join where it is large
    places = materialize(places.groupBy(*EPISODE, "us", "event_id").agg(F.max("times").alias("times")), "places")
    at = [*KEY, "us", "event_id"]
    if whole is not None:
        places = detections.select(*KEY, micros(F.col("triggered_at")).alias("us"), "event_id", "batch").join(places, at).distinct()
        places = materialize(places, "shown")
        at = [*at, "batch"]
    names = ["involved_users", "involved_hosts"]
    listed = detections.select(*KEY, F.lit(1).cast("bigint").alias("episode"), *names)
    if split:
        listed = detections.select(*KEY, micros(F.col("triggered_at")).alias("us"), "event_id", *names).join(
            numbered.select(*EPISODE, "us", "event_id"), [*KEY, "us", "event_id"])
    keyed = body.join(_told(detections if whole is None else whole, places, at), EPISODE, "left").join(_smallest(listed, names, EPISODE, MAX_INVOLVED), EPISODE, "left")
    empty = F.array().cast("array<string>")
    return keyed.select(
        *EPISODE, "firings", "lift", "confidence", "anomaly_score", "first_us", "first_event", "last_us",
        "first.source_ip", "first.affected_host", "first.recommended_action", "first.detection_kind", "metadata",
        "top.title", "top.description", "top.severity", "evidence",
        F.coalesce("involved_users", empty).alias("involved_users"),
        F.coalesce("involved_hosts", empty).alias("involved_hosts"),
    )


def alert_id(rule: Column, key: Column, first_event: Column) -> Column:
    """Stable id in UUID form, so that a retried batch writes the same alert."""
    h = F.md5(F.concat_ws("|", rule, key, first_event))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def as_alerts(
    folded: DataFrame, closed: DataFrame | None = None, keep: tuple[str, ...] = ("episode",)
) -> DataFrame:
    """Folded rows as ALERT rows, with the columns `keep` in front.

    `closed` holds the effective triage rows of each episode.
    """
    if closed is None:
        df = folded.withColumn("status", F.lit("open"))
    else:
        final = closed.groupBy(*EPISODE).agg(F.max_by("status", F.struct("us", "tie")).alias("status"))
        df = folded.join(final, EPISODE, "left").withColumn("status", F.coalesce("status", F.lit("open")))
    made = df.select(
        "*",
        alert_id(F.col("rule_id"), F.col("correlation_key"), F.col("first_event")).alias("alert_id"),
        F.timestamp_micros("first_us").alias("first_seen"),
        F.timestamp_micros("last_us").alias("last_seen"),
        (F.col("firings") + F.col("lift")).alias("event_count"),
        F.array().alias("status_history"),
        F.timestamp_micros("first_us").alias("created_at"),
        F.timestamp_micros("last_us").alias("updated_at"),
    )
    return made.select(*keep, *[F.col(f.name).cast(f.dataType).alias(f.name) for f in ALERT])


def correlate(
    detections: DataFrame, triage: DataFrame | None = None, chunk_seconds: int = CHUNK_SECONDS,
    store: bool = True, whole: DataFrame | None = None,
) -> DataFrame:
    """Alerts of a detection set, one row per episode.

    The fold reads the detections several times; `store` writes them once to the shared folder
    first. Pass store=False for detections that are already a table. `whole`: see `fold`.
    """
    if store:
        detections = materialize(detections, "detections")
    numbered, closed = split_episodes(detections, triage, chunk_seconds)
    if triage is not None:
        numbered = materialize(numbered, "numbered")
    return as_alerts(fold(detections, numbered, chunk_seconds, triage is not None, whole), closed)


def merge_alerts(stored: DataFrame, detections: DataFrame, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Fold a batch of detections into stored alerts; returns the created and changed alerts.

    Only active stored alerts absorb firings (C9). With a stored count c and m new firings with
    hints h_j the count becomes m + max(c, max(h_j - j)); other fields combine first/last/max.
    """
    numbered, _ = split_episodes(detections, None, chunk_seconds)
    fresh = as_alerts(fold(detections, numbered, chunk_seconds), keep=("firings", "lift"))
    active = stored.filter(F.col("status").isin("open", "acknowledged", "investigating")).select(
        *KEY, F.struct(*[f.name for f in ALERT]).alias("old")
    )
    joined = fresh.select(
        *KEY, "firings", "lift", F.struct(*[f.name for f in ALERT]).alias("new")
    ).join(active, KEY, "left")
    o, n = (lambda f: F.col(f"old.{f}")), (lambda f: F.col(f"new.{f}"))
    worse = severity_rank(n("severity")) > severity_rank(o("severity"))
    known = F.col("old").isNotNull()

    def union_of(f: str) -> Column:
        return F.slice(F.array_sort(F.array_union(o(f), n(f))), 1, MAX_INVOLVED)

    both = F.concat(o("evidence"), F.array_except(n("evidence"), o("evidence")))
    tail = F.slice(both, F.greatest(F.size(both) - (MAX_EVIDENCE - 1), F.lit(1)), MAX_EVIDENCE)
    merged = {
        "last_seen": F.greatest(o("last_seen"), n("last_seen")),
        "updated_at": F.greatest(o("updated_at"), n("updated_at")),
        "event_count": F.col("firings") + F.greatest(o("event_count"), F.col("lift")),
        "confidence": F.greatest(o("confidence"), n("confidence")),
        "anomaly_score": F.greatest(o("anomaly_score"), n("anomaly_score")),
        "severity": F.when(worse, n("severity")).otherwise(o("severity")),
        "title": F.when(worse, n("title")).otherwise(o("title")),
        "description": F.when(worse, n("description")).otherwise(o("description")),
        "involved_users": union_of("involved_users"),
        "involved_hosts": union_of("involved_hosts"),
        "evidence": tail,
        "metadata": F.map_concat(
            F.map_filter(o("metadata"), lambda k, v: ~F.array_contains(F.map_keys(n("metadata")), k)), n("metadata")
        ),
    }
    return joined.select(*[
        F.when(known, merged.get(f.name, o(f.name))).otherwise(n(f.name)).cast(f.dataType).alias(f.name)
        for f in ALERT
    ])
