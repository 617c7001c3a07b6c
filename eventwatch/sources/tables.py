"""Event, detection, alert, audit and feed tables on shared storage.

Every write carries the id of the micro-batch that made it and replaces what that batch wrote
before. What a reader sees is decided by the last manifest (`commits`): rows of batches up to it, and the id
runs and alert files it names.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.normalize import dedup
from ..schema import ALERT, AUDIT, DETECTION, SECURITY_EVENT
from ..session import materialize, shuffles_dropped, spread
from .commits import Commits

KEY = ["rule_id", "correlation_key"]


def names(schema: T.StructType) -> list[str]:
    return [f.name for f in schema]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _ddl(schema: T.StructType, extra: str = "") -> str:
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return f"{own}, {extra}" if extra else own


def _read(spark: SparkSession, base: str, schema: T.StructType, extra: str, paths: Iterable[str] | None = None) -> DataFrame:
    """The table at `base`, or only the given folders of it that exist."""
    found = [p for p in ([base] if paths is None else paths) if _exists(spark, p)]
    if not found:
        return spark.createDataFrame([], _ddl(schema, extra))
    return spark.read.schema(_ddl(schema, extra)).option("basePath", base).parquet(*found)


#: Files a task keeps open; rows of so many partitions are written as they come, without a sort of whole rows.
OPEN_FILES = 40


def _replace(df: DataFrame, path: str, *parts: str, placed: bool = False) -> None:
    """Write `df`, replacing the partitions it has rows for; large partitions are split, small ones share a task.

    `placed`: the rows are so dealt already.
    """
    conf, name = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, str(OPEN_FILES))
    try:
        rows = df if placed else df.hint("rebalance", parts[0])
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
    finally:
        conf.set(name, before)


# --- events -----------------------------------------------------------------------------------

def read_events(spark: SparkSession, root: str, upto: int | None = None, days: Iterable[date] | None = None) -> DataFrame:
    """Stored events with event_date and batch, of committed batches or those up to `upto`; `days`: only those folders."""
    upto = Commits(spark, root).latest()["batch"] if upto is None else upto
    base = f"{root}/events"
    paths = None if days is None else [f"{base}/event_date={d}" for d in sorted(set(days))]
    return _read(spark, base, SECURITY_EVENT, "event_date date, batch bigint", paths).filter(F.col("batch") <= upto)


#: Ids of a batch that are looked up one by one, PROBE of them in a scan; a larger batch is joined with the whole index.
PROBED, PROBE = 1000, 200
#: Runs of a level that are merged into one of the next.
FAN = 4
#: Rows of a run's file, and of a row group (about), whose Bloom filter must stay below a megabyte.
RUN_ROWS, GROUP_ROWS = 4_000_000, 500_000
RUN_SCHEMA = T.StructType([T.StructField("h", T.LongType()), SECURITY_EVENT["event_id"]])


class IdIndex:
    """Stored event ids as runs sorted by hash, merged level by level (A5).

    A run is written with Parquet's Bloom filters and page index on the hash. The ids of a batch of up to
    PROBED are pushed into scans as equalities: row groups whose filter knows none of them and pages whose range
    holds none are not read, so what a batch reads follows its own size and the number of runs, which grows with the
    logarithm of the history. A hash that meets is checked by the id itself.
    """

    def __init__(self, spark: SparkSession, root: str, runs: list[dict]) -> None:
        self.spark, self.root, self.runs = spark, root, [dict(r) for r in runs]
        self.dropped: list[str] = []

    def _scan(self, runs: list[dict]) -> DataFrame:
        return self.spark.read.schema(_ddl(RUN_SCHEMA)).parquet(*[f"{self.root}/{r['path']}" for r in runs])

    def probe(self, hashes: list[int]) -> DataFrame:
        """(h, event_id) of the stored ids with these hashes."""
        # a longer list would be pushed as one set, which is compared with pages by its ends only
        self.spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(PROBE))
        scan, found = self._scan(self.runs), None
        for i in range(0, len(hashes), PROBE):
            part = scan.filter(F.col("h").isin(hashes[i:i + PROBE]))
            found = part if found is None else found.unionByName(part)
        return found

    def known(self, arrived: DataFrame) -> DataFrame:
        """event_id of the rows of `arrived` (a table with h and event_id) that are stored already."""
        # one more than the bound tells a larger batch apart
        hashes = [r.h for r in arrived.select("h").limit(PROBED + 1).collect()] if self.runs else []
        if not hashes:
            return arrived.select("event_id").limit(0)
        stored = self._scan(self.runs) if len(hashes) > PROBED else self.probe(hashes)
        return stored.join(arrived.select("h", "event_id"), ["h", "event_id"], "left_semi").select("event_id")

    def add(self, ids: DataFrame, rows: int, batch_id: int) -> None:
        """A run of the batch's new ids, then as many merges as full levels ask for."""
        if not rows:
            return
        self._write(ids.select("h", "event_id"), rows, 0, batch_id)
        level = 0
        while len(full := [r for r in self.runs if r["level"] == level]) >= FAN:
            self.runs = [r for r in self.runs if r["level"] != level]
            self.dropped += [r["path"] for r in full]
            self._write(self._scan(full), sum(r["rows"] for r in full), level + 1, batch_id)
            level += 1

    def _write(self, ids: DataFrame, rows: int, level: int, batch_id: int) -> None:
        path = f"ids/level={level}-batch={batch_id}"
        parts = -(-rows // RUN_ROWS)
        (
            ids.repartitionByRange(parts, "h").sortWithinPartitions("h").write.mode("overwrite")
            .option("parquet.bloom.filter.enabled#h", "true").option("parquet.bloom.filter.expected.ndv#h", str(min(rows, GROUP_ROWS)))
            .option("parquet.block.size", str(16 << 20)).option("parquet.page.row.count.limit", "500").parquet(f"{self.root}/{path}")
        )
        self.runs.append({"path": path, "level": level, "rows": rows})


def append_events(batch: DataFrame, root: str, batch_id: int, manifest: dict) -> tuple[DataFrame, dict]:
    """Store the events whose id is not stored yet, on whatever day.

    Returns the rows stored and the manifest with the new id index; nothing is visible before it is committed.
    """
    spark = batch.sparkSession
    index = IdIndex(spark, root, manifest["ids"])
    arrived = materialize(dedup(batch).withColumn("h", F.xxhash64("event_id")), "arrived")
    new = arrived.join(index.known(arrived), "event_id", "left_anti").withColumns(
        {"event_date": F.to_date("timestamp"), "batch": F.lit(batch_id).cast("bigint")})
    _replace(new.select(*names(SECURITY_EVENT), "event_date", "batch"), f"{root}/events", "event_date", "batch")
    days = [r.d for r in arrived.select(F.to_date("timestamp").alias("d")).distinct().collect()]
    stored = read_events(spark, root, batch_id, days).filter(F.col("batch") == batch_id)
    index.add(stored.select(F.xxhash64("event_id").alias("h"), "event_id"), stored.count(), batch_id)
    return stored, {**manifest, "ids": index.runs, "dropped": [*manifest.get("dropped", []), *index.dropped]}


# --- detections -------------------------------------------------------------------------------

EMIT, RETRACT = "emit", "retract"


def write_detections(changes: DataFrame, root: str, batch_id: int) -> DataFrame:
    """Store a batch's changelog of firings (`op` is emit or retract, `content` as in `matches`), dealt by day; returns it."""
    rows = changes.withColumns({"day": F.to_date("triggered_at"), "batch": F.lit(batch_id).cast("bigint"), "bucket": bucket()})
    path = f"{root}/detections"
    _replace(rows.select(*names(DETECTION), "content", "op", "bucket", "day", "batch"), path, "day", "batch", placed=True)
    return read_changes(changes.sparkSession, root, batch_id).filter(F.col("batch") == batch_id)


def read_changes(spark: SparkSession, root: str, upto: int | None = None, days: Iterable[date] | None = None) -> DataFrame:
    """The changelog of firings, with content, op, bucket, day and batch. A retraction has the firing's keys and time only."""
    upto = Commits(spark, root).latest()["batch"] if upto is None else upto
    base = f"{root}/detections"
    paths = None if days is None else [f"{base}/day={d}" for d in sorted(set(days))]
    return _read(spark, base, DETECTION, "content bigint, op string, bucket int, day date, batch bigint", paths).filter(F.col("batch") <= upto)


def live_changes(changes: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of the firings that hold: those emitted and not retracted by a later batch.

    Only firings older than the last retraction are shuffled, and none is sorted.
    """
    key = ["rule_id", "event_id", "day"]
    emits = changes.filter((F.col("op") == EMIT) & F.col("rule_id").isNotNull() & F.col("event_id").isNotNull() & F.col("day").isNotNull())
    back = changes.filter(F.col("op") == RETRACT)
    top = back.agg(F.max("batch")).first()[0]
    if top is None:
        return emits.select(*columns)
    gone = back.groupBy(*key).agg(F.max("batch").alias("gone"))
    older = spread(emits.filter(F.col("batch") < top).select(*dict.fromkeys([*columns, *key, "batch"])), *key).alias("e")
    same = [F.col(f"e.{k}") == F.col(f"g.{k}") for k in key]
    held = older.join(spread(gone, *key).alias("g").hint("shuffle_hash"), [*same, F.col("g.gone") > F.col("e.batch")], "left_anti")
    return held.select(*columns).unionByName(emits.filter(F.col("batch") >= top).select(*columns))


def current_detections(changes: DataFrame) -> DataFrame:
    """The firings that hold."""
    return live_changes(changes, names(DETECTION))


# --- alerts -----------------------------------------------------------------------------------

ALERT_BUCKETS = 32
#: Deltas of a bucket that a new base takes in.
MAX_DELTAS = 6


def bucket() -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(ALERT_BUCKETS)).cast("int")


class AlertStore:
    """Alerts in buckets by key: a base and later deltas, merged on read and rewritten per touched bucket.

    The state in the manifest is {bucket: {"base": batch or None, "deltas": [batches]}}. A batch writes one delta
    for the buckets it touches; a bucket with MAX_DELTAS of them gets a new base.
    """

    def __init__(self, spark: SparkSession, root: str, state: dict) -> None:
        self.spark, self.root = spark, root
        self.state = {b: {"base": s["base"], "deltas": list(s["deltas"])} for b, s in state.items()}
        self.dropped: list[str] = []

    def _folder(self, kind: str, batch: int, b: str) -> str:
        return f"alerts/kind={kind}/batch={batch}/bucket={b}"

    def read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """Current alerts, of all buckets or only those given."""
        wanted = self.state.keys() if buckets is None else {str(b) for b in buckets} & self.state.keys()
        paths = []
        for b in sorted(wanted):
            s = self.state[b]
            paths += [f"{self.root}/{self._folder('base', s['base'], b)}"] if s["base"] is not None else []
            paths += [f"{self.root}/{self._folder('delta', d, b)}" for d in s["deltas"]]
        rows = _read(self.spark, f"{self.root}/alerts", ALERT, "deleted boolean, kind string, batch bigint, bucket int", paths)
        last = rows.groupBy("bucket", "alert_id").agg(F.max("batch").alias("batch"))
        return rows.join(last, ["bucket", "alert_id", "batch"]).filter(~F.col("deleted")).select(*names(ALERT))

    def write(self, changed: DataFrame, batch_id: int) -> None:
        """Upsert `changed` (ALERT and `deleted`), a table."""
        rows = changed.withColumn("bucket", bucket())
        touched = [str(r.bucket) for r in rows.select("bucket").distinct().collect()]
        if not touched:
            return
        rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/alerts/kind=delta/batch={batch_id}")
        full = []
        for b in touched:
            s = self.state.setdefault(b, {"base": None, "deltas": []})
            s["deltas"].append(batch_id)
            full += [b] if len(s["deltas"]) >= MAX_DELTAS else []
        if full:
            self.read(full).withColumns({"deleted": F.lit(False), "bucket": bucket()}).hint("rebalance", "bucket").write.mode("overwrite").partitionBy(
                "bucket").parquet(f"{self.root}/alerts/kind=base/batch={batch_id}")
            for b in full:
                s = self.state[b]
                self.dropped += [self._folder("delta", d, b) for d in s["deltas"]]
                self.dropped += [self._folder("base", s["base"], b)] if s["base"] is not None else []
                self.state[b] = {"base": batch_id, "deltas": []}


def read_alerts(spark: SparkSession, root: str) -> DataFrame:
    """Current alerts of the last committed batch."""
    return AlertStore(spark, root, Commits(spark, root).latest()["alerts"]).read()


# --- audit and feed ---------------------------------------------------------------------------

def append_audit(audit: DataFrame, path: str, batch_id: int) -> None:
    # a request on many alerts is as many rows that differ in their target only: zstd leaves about three fifths of what snappy does
    with shuffles_dropped(audit.sparkSession):
        audit.select(*names(AUDIT)).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={batch_id}")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, AUDIT, "batch bigint").drop("batch")


FEED_EVENTS = 100
FEED = T.StructType([T.StructField("channel", T.StringType()), T.StructField("value", T.StringType())])


def write_feed(events: DataFrame, alerts: DataFrame, root: str, batch_id: int) -> None:
    """Live feed of a batch: its newest 100 events, and every alert it touched."""
    items = events.orderBy(F.desc("timestamp"), "event_id").limit(FEED_EVENTS).select(
        F.lit("events").alias("channel"), F.to_json(F.struct(*names(SECURITY_EVENT))).alias("value"))
    items = items.unionByName(alerts.select(F.lit("alerts").alias("channel"), F.to_json(F.struct(*names(ALERT))).alias("value")))
    items.write.mode("overwrite").parquet(f"{root}/feed/batch={batch_id}")


def read_feed(spark: SparkSession, root: str) -> DataFrame:
    """The feed of committed batches: channel, value, batch."""
    return _read(spark, f"{root}/feed", FEED, "batch bigint").filter(F.col("batch") <= Commits(spark, root).latest()["batch"])


def topic_rows(events: DataFrame, key: str = "source_ip") -> DataFrame:
    """Key/value rows for a topic: JSON value keyed by source address."""
    return events.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))
