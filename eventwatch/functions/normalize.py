"""Raw JSON text -> SECURITY_EVENT rows and rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..schema import EVENT_STATUSES, EVENT_TYPES, SECURITY_EVENT, SEVERITIES, SOURCE_TYPES
from .ip import bind, canonical_ip

# Text and metadata limits, tolerated clock skew, the name space of derived ids.
MAX_TEXT = 512
MAX_MESSAGE = 2048
MAX_META = 50
MAX_META_KEY = 128
MAX_SKEW_SECONDS = 86_400
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
MAX_BYTES = 2 ** 63 - 1

KNOWN = [f.name for f in SECURITY_EVENT]
SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85   　"
ENTRIES = "array<struct<key:string,value:string>>"


def _dashed(hexes: Column) -> Column:
    return F.regexp_replace(hexes, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def _name_hex(text: Column) -> Column:
    """Version-5 UUID of `text` in the URL name space, without dashes."""

    def marked(h: Column) -> Column:
        variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
        return F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))

    return bind(F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(text, "UTF-8"))), marked)


def name_uuid(text: Column) -> Column:
    return _dashed(_name_hex(text))


def event_uuid(raw_id: Column, payload: Column) -> Column:
    """Canonical UUID, a name-based one for other ids, one of the payload when there is no id."""
    bare = F.regexp_replace(raw_id, "urn:|uuid:", "")
    hexes = F.lower(F.regexp_replace(F.btrim(bare, F.lit("{}")), "-", ""))
    name = F.when(F.coalesce(raw_id, F.lit("")) == "", payload).otherwise(raw_id)
    return _dashed(F.when(hexes.rlike("^[0-9a-f]{32}$"), hexes).otherwise(_name_hex(name)))


DATE = r"^(\d{4})-?(\d{2})-?(\d{2})"
CLOCK = r"(?:.(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?"
ZONE = r"([+-]\d{2}(?::?\d{2})?)?)?$"


def event_time(raw: Column, now: Column) -> Column:
    """Instant of a timestamp field; `now` when missing or too far ahead, null when unreadable."""
    iso = DATE + CLOCK + ZONE

    def two(x: Column) -> Column:
        return F.when(x == "", "00").otherwise(x)

    def from_text(text: Column) -> Column:
        g = [F.regexp_extract(text, iso, i) for i in range(9)]
        offset = F.when(g[8] == "", "+00:00").otherwise(
            F.concat(F.substring(g[8], 1, 3), F.lit(":"), two(F.regexp_extract(text, r"[+-]\d{2}:?(\d{2})$", 1)))
        )
        whole = F.concat(
            F.concat_ws("-", g[1], g[2], g[3]), F.lit("T"), F.concat_ws(":", two(g[4]), two(g[5]), two(g[6])),
            F.lit("."), F.rpad(F.substring(g[7], 1, 6), 6, "0"), offset,
        )
        return F.when(text.rlike(iso), whole.try_cast("timestamp"))

    def from_number(seconds: Column) -> Column:
        return F.when(
            seconds.between(-62135596800, 253402300799), F.timestamp_micros(F.round(seconds * 1e6).cast("bigint"))
        )

    def clamped(at: Column) -> Column:
        ahead = F.unix_micros(at) - F.unix_micros(now) > MAX_SKEW_SECONDS * 1_000_000
        return F.when(ahead, now).otherwise(at)

    text = F.replace(F.btrim(raw, F.lit(SPACE)), F.lit("Z"), F.lit("+00:00"))
    numeric = raw.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$") & ~raw.rlike(r"^\d{8}$")
    at = F.when(numeric, from_number(raw.try_cast("double"))).otherwise(bind(text, from_text))
    return F.when(raw.isNull(), now).otherwise(bind(at, clamped))


def clipped(raw: Column, limit: int = MAX_TEXT) -> Column:
    """Stripped and cut to `limit`; null when nothing is left."""
    text = F.btrim(raw, F.lit(SPACE))
    return F.when(text != "", F.substring(text, 1, limit))


def whole_number(raw: Column) -> Column:
    """Integer value of a field as DECIMAL(38,0), cut towards zero; null when not a number."""
    text = F.btrim(raw, F.lit(SPACE))
    return F.when(text.rlike(r"^[+-]?\d{1,38}(\.\d+)?$"), F.regexp_extract(text, r"^([+-]?\d+)", 1).try_cast("decimal(38,0)"))


def port(raw: Column) -> Column:
    n = whole_number(raw)
    return F.when(n.between(0, 65535), n.cast("int"))


def byte_count(raw: Column) -> Column:
    n = whole_number(raw)
    huge = F.btrim(raw, F.lit(SPACE)).rlike(r"^\+?\d{39,}$")
    fit = F.least(F.greatest(n, F.lit(0).cast("decimal(38,0)")), F.lit(MAX_BYTES).cast("decimal(38,0)"))
    return F.coalesce(F.when(huge, F.lit(MAX_BYTES)).otherwise(fit.cast("bigint")), F.lit(0)).cast("bigint")


def one_of(raw: Column, values: list[str], other: str) -> Column:
    return F.when(F.lower(raw).isin(values), F.lower(raw)).otherwise(other)


def metadata(fields: Column, raw_meta: Column) -> Column:
    """Metadata object plus unknown top-level fields it lacks: first 50 items, keys cut to 128."""
    meta = F.coalesce(F.map_entries(F.from_json(raw_meta, "map<string,string>")), F.array().cast(ENTRIES))
    names = F.transform(meta, lambda e: e["key"])
    extra = F.filter(
        F.map_entries(fields),
        lambda e: ~e["key"].isin([*KNOWN, "metadata"]) & ~F.array_contains(names, e["key"]),
    )
    kept = F.transform(
        F.slice(F.concat(meta, extra), 1, MAX_META),
        lambda e: F.struct(F.substring(e["key"], 1, MAX_META_KEY).alias("key"), e["value"].alias("value")),
    )

    def unique(items: Column) -> Column:
        # keys cut to the same text: the last one stays
        keys = F.reverse(F.transform(items, lambda e: e["key"]))
        return bind(keys, lambda k: F.filter(
            items, lambda e, i: i == F.size(items) - F.array_position(k, e["key"])))

    return F.map_from_entries(bind(kept, unique))


def normalize(raw: DataFrame, now: Column | None = None, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """Split raw JSON rows into (SECURITY_EVENT rows, rejects with a reason and the raw text).

    One narrow projection in both directions: nothing shuffles and bad rows never fail the job.
    """
    now = F.current_timestamp() if now is None else now
    # Exploding a one-element array computes the parse once: filters on the result cannot be
    # pushed below it, which would repeat the parse for every mention.
    parsed = raw.select(F.col(text).alias("raw")).select(
        "raw", F.explode(F.array(F.from_json("raw", "map<string,string>"))).alias("m"))

    def field(name: str) -> Column:
        return F.element_at("m", name)

    timed = parsed.select("raw", "m", F.explode(F.array(event_time(field("timestamp"), now))).alias("at"))
    reason = (
        F.when(F.col("m").isNull(), "undecodable").when(F.col("at").isNull(), "timestamp")
    )
    judged = timed.withColumn("reason", reason)
    made = {
        "event_id": event_uuid(field("event_id"), F.col("raw")),
        "timestamp": F.col("at"),
        "ingested_at": now,
        "source": F.coalesce(clipped(field("source")), F.lit("unknown")),
        "source_type": one_of(field("source_type"), SOURCE_TYPES, "unknown"),
        "event_type": one_of(field("event_type"), EVENT_TYPES, "unknown"),
        "source_ip": canonical_ip(field("source_ip")),
        "destination_ip": canonical_ip(field("destination_ip")),
        "destination_port": port(field("destination_port")),
        "username": clipped(field("username")),
        "service": clipped(field("service")),
        "action": clipped(field("action")),
        "status": F.when(field("status").isNotNull(), one_of(field("status"), EVENT_STATUSES, "info")),
        "severity": one_of(field("severity"), SEVERITIES, "info"),
        "message": clipped(field("message"), MAX_MESSAGE),
        "bytes_out": byte_count(field("bytes_out")),
        "bytes_in": byte_count(field("bytes_in")),
        "metadata": metadata(F.col("m"), field("metadata")),
    }
    valid = judged.filter("reason is null").select(
        *[made[f.name].cast(f.dataType).alias(f.name) for f in SECURITY_EVENT]
    )
    return valid, judged.filter("reason is not null").select("reason", "raw")


def dedup(events: DataFrame, within: str = "10 minutes") -> DataFrame:
    """First copy of each event id.

    Batch: the earliest row, ties by content; each task keeps one row per id before the shuffle, so an id copied
    many times stays cheap. Stream: the first copy seen, remembered for `within`.
    """
    if events.isStreaming:
        return events.withWatermark("timestamp", within).dropDuplicatesWithinWatermark(["event_id"])
    maps = [f.name for f in events.schema if isinstance(f.dataType, T.MapType)]
    content = F.xxhash64(*[c for c in events.columns if c not in maps])
    rank = F.row_number().over(W.partitionBy("event_id").orderBy("timestamp", "ingested_at", content, *map(F.to_json, maps)))
    return events.withColumn("_n", rank).filter("_n = 1").drop("_n")
