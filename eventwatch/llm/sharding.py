"""Sharding: a keyed shuffle of global row numbers by a Feistel permutation (operator 3).

Law kept: `rows`. Rows get global numbers 0..n-1, the permutation sends each number to a place, and
shard = place mod shards, slot = place div shards. So shard sizes in rows differ by at most one, slots
have no gaps, and anyone who knows n, the key and a row number can compute shard and slot.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from eventwatch.session import materialize

ROUNDS = 4
#: Multipliers and offsets of the round function, one pair per round.
MULTIPLIERS = (2654435761, 2246822519, 3266489917, 668265263)
OFFSETS = (374761393, 3332679571, 1013904223, 69069)
_MASK = 0xFFFFFFFF


def halves(n: int) -> tuple[int, int]:
    """Smallest a × b grid of nearly square shape that holds n places."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _round_value(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    y = ((x + np.uint64(seed + OFFSETS[k])) * np.uint64(MULTIPLIERS[k])) & np.uint64(_MASK)
    y = ((y ^ (y >> np.uint64(15))) * np.uint64(MULTIPLIERS[(k + 1) % ROUNDS])) & np.uint64(_MASK)
    return y ^ (y >> np.uint64(13))


def permute(number: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Place of each row number below n: a bijection of 0..n-1.

    The network works on pairs (x below a, y below b) with modular addition in place of xor, so the
    grid holds hardly more than n places; numbers that land outside walk the cycle until inside.
    """
    if n <= 1:
        return np.zeros(len(number), np.int64)
    a, b = (np.uint64(v) for v in halves(n))
    value = np.asarray(number, np.uint64)
    todo = np.arange(len(value))
    while len(todo):
        x, y = value[todo] // b, value[todo] % b
        for k in range(ROUNDS):
            if k % 2 == 0:
                x = (x + _round_value(y, k, seed)) % a
            else:
                y = (y + _round_value(x, k, seed)) % b
        value[todo] = x * b + y
        todo = todo[value[todo] >= np.uint64(n)]
    return value.astype(np.int64)


def place_of(number: Column, total: Column, seed: int = 0) -> Column:
    @F.pandas_udf(T.LongType())
    def places(i: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(permute(i.to_numpy(), int(n.iloc[0]) if len(n) else 0, seed))

    return places(number, total)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with row_number (0..n-1 in `order`) and n_rows.

    Rows equal in every column are first counted, so even a third of all rows being one row is one
    row to sort. The rest is one range-partitioned sort, written once (its bounds come from a sample
    and must not be drawn twice); the offsets are one row per partition.
    """
    each = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = each.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    stored = materialize(ordered.withColumn("spot", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("spot", 33)
    sums = stored.groupBy(part.alias("part")).agg(F.sum("copies").alias("held"))
    # one row per partition of the sort: their number is the session's setting, not the data's
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"),
        F.sum("held").over(Window.partitionBy()).alias("n_rows"))
    inside = Window.partitionBy("part").orderBy("spot").rowsBetween(Window.unboundedPreceding, -1)
    placed = stored.withColumn("part", part).join(F.broadcast(offsets), "part")
    start = F.col("before") + F.coalesce(F.sum("copies").over(inside), F.lit(0))
    return placed.withColumn("start", start).select(
        *rows.columns, "n_rows",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), "start",
    ).select(*rows.columns, (F.col("start") + F.col("copy")).alias("row_number"), "n_rows")


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), row_number.

    size is the UTF-8 length of the text (null: 0) plus one. Rows are numbered by (doc_id, size,
    text_crc32), nulls first, so the result does not depend on how the input is partitioned; rows
    equal in all three are interchangeable. Other columns are ignored; an empty table gives no rows.
    The text itself is never shuffled.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    rows = numbered(narrow, ["doc_id", "size", "text_crc32"])
    placed = rows.withColumn("place", place_of(F.col("row_number"), F.col("n_rows"), seed))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_number")
