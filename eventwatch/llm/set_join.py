"""Shared parts of the exact set-similarity joins: rarity order, prefixes, bitmaps, verification.

A set is the distinct word shingles of a text or line. Its elements are ordered by rarity, and a pair
with Jaccard t or more must share an element among the first n - ⌈t·n⌉ + 1 of both. Three further
filters never lose a pair: sizes (n₁ ≥ t·n₂), positions (what can still overlap after a shared
element), and parity bitmaps (each bit in which two bitmaps differ stands for at least one element
only one of the sets has).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from eventwatch.llm.text_arrays import Words, id_and_text, lists, mix, shingles, signed, slices, within
from eventwatch.session import materialize, shared_dir

#: The most frequent words whose counts travel to the tasks (12 bytes each): a fixed size.
FREQUENT_WORDS = 1 << 16
#: Smallest and largest bitmap of a set.
BITMAP_BITS = (256, 1 << 15)
#: Word counts a task holds before it merges and sends them.
HELD_COUNTS = 1 << 20
#: Bytes of text a task verifies in one step.
CHECKED_BYTES = 1 << 18
#: Pairs of rows a task looks at in one step.
PAIR_CHUNK = 1 << 20


def merged_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(value, count) parts summed by value."""
    values, counts = (np.concatenate(x) for x in zip(*parts))
    seen, place = np.unique(values, return_inverse=True)
    return seen, np.bincount(place, weights=counts, minlength=len(seen)).astype(np.int64)


@dataclass
class Rarity:
    """Counts of the most frequent words; a shingle is as rare as its rarest word."""

    words: np.ndarray
    level: np.ndarray

    def of_words(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(hashes), np.int8)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.level[at], 0).astype(np.int8)


def word_rarity(docs: DataFrame, limit: int = FREQUENT_WORDS) -> Rarity:
    """Count the words of the whole corpus and keep about the `limit` most frequent ones, as powers of two."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes = [], 0  # counts of some slices, merged and sent when they are many
        send = lambda: pa.RecordBatch.from_arrays([pa.array(a) for a in merged_counts(held)], ["word", "n"])
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(1)):
                seen, n = np.unique(Words(data, offsets).hash, return_counts=True)
                held.append((signed(seen), n))
                sizes += len(seen)
                if sizes > HELD_COUNTS:
                    yield send()
                    held, sizes = [], 0
        if held:
            yield send()

    counted = id_and_text(docs).mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")
    counted = materialize(counted.withColumn("step", F.floor(16 * F.log2("n")).cast("int")), "word-counts")
    # at most 16 steps a power of two come to the driver, then the words of the highest steps that fit
    steps, held = counted.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect(), 0
    lowest = 1 << 30
    for step, n in sorted(((r.step, r.n) for r in steps), reverse=True):
        held += n
        if held > limit:
            break
        lowest = step
    top = counted.filter(F.col("step") >= lowest).select("word", "n").toPandas()
    words = np.ascontiguousarray(top.word.to_numpy(np.int64)).view(np.uint64)
    order = np.argsort(words)
    return Rarity(words[order], np.log2(top.n.to_numpy(float) + 1).astype(np.int8)[order])


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


@dataclass
class Sets:
    """Distinct shingles of the rows of a slice: `hash`, sorted by rarity within `row`, and sizes `n`."""

    hash: np.ndarray
    row: np.ndarray
    n: np.ndarray

    def prefixes(self, percent: int, wanted: np.ndarray | bool = True) -> pa.ListArray:
        """The elements by which a set finds its partners; empty for rows not `wanted`."""
        size = np.where((self.n > 0) & wanted, prefix_length(self.n, percent), 0)
        first = np.repeat(np.cumsum(self.n) - self.n, size) + within(size)
        return lists(signed(self.hash[first]), size, pa.int64())

    def bitmaps(self) -> list[bytes]:
        """Parity bitmap per row, half a bit to one bit an element, a power of two in all."""
        size = np.clip(1 << np.floor(np.log2(np.maximum(self.n, 1))).astype(np.int64), *BITMAP_BITS)
        base = np.cumsum(size) - size
        spot = base[self.row] + (self.hash & (size[self.row] - 1).astype(np.uint64)).astype(np.int64)
        flat = np.packbits((np.bincount(spot, minlength=int(size.sum())) & 1).astype(np.uint8), bitorder="little").tobytes()
        return [flat[i:i + k] for i, k in zip((base // 8).tolist(), (size // 8).tolist())]


def row_order(row: np.ndarray, level: np.ndarray | int, low: np.ndarray) -> np.ndarray:
    """Order of (row, level, low): one sort of these packed in 64 bits, by all three where that is not enough."""
    if len(row) and row[-1] < 1 << 20:
        packed = (row.astype(np.uint64) << np.uint64(44)) | (np.uint64(level) << np.uint64(37)) | (low >> np.uint64(27))
        at = np.argsort(packed)
        p, q = packed[at], low[at]
        if not ((p[1:] == p[:-1]) & (q[1:] != q[:-1])).any():
            return at
    return np.lexsort((low, np.broadcast_to(level, len(row)), row))


def sequence_keys(words: Words) -> list[bytes]:
    """A 128-bit fingerprint of each row's word sequence; rows without words share one."""
    counts = np.diff(words.first)
    out = np.zeros((len(counts), 2), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        place, heads = within(counts).astype(np.uint64), words.first[some]
        out[some, 0] = np.add.reduceat(mix(words.hash + place * np.uint64(0x9E3779B97F4A7C15)), heads)
        out[some, 1] = np.add.reduceat(mix((words.hash ^ np.uint64(0x5851F42D4C957F2D)) + place * np.uint64(0xD1342543DE82EF95)), heads)
    raw = out.tobytes()
    return [raw[16 * i:16 * i + 16] for i in range(len(counts))]


def shingle_sets(words: Words, size: int, rarity: Rarity | None = None) -> Sets:
    h, row = shingles(words, size)
    if rarity is None:
        level = np.zeros(len(h), np.int8)
    else:
        rare = rarity.of_words(words.hash)
        counts = np.diff(words.first)
        whole = np.maximum(counts - size + 1, 0)
        start = np.repeat(words.first[:-1], whole) + within(whole)
        level = rare[start].copy() if len(start) else np.zeros(0, np.int8)
        for k in range(1, size):
            level = np.minimum(level, rare[start + k])
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            level = np.r_[level, [rare[words.first[r]:words.first[r + 1]].min() for r in short]]
    # one sort by (row, level, hash); where the packed key cannot tell two hashes apart, by all three
    packed_key = ((row * 32 + level).astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
    order = np.argsort(packed_key)
    key, hash_ = packed_key[order], h[order]
    if len(words.first) > 1 << 19 or ((key[1:] == key[:-1]) & (hash_[1:] != hash_[:-1])).any():
        order = np.lexsort((h, level, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    return Sets(h, row, np.bincount(row, minlength=len(words.first) - 1))


# --- blocks: rows that share a prefix element -------------------------------------------------------

def shared_elements(rows: DataFrame) -> DataFrame:
    """Of rows with a `token` and an `id`, those whose token occurs in another row.

    The rows are range-partitioned by (token, id), so one element held by a third of all rows spreads
    over many tasks, each of which looks at neighbouring rows only. Rows next to a partition's edge may
    stay although alone; a later grouping drops them.
    """
    names = rows.columns
    spread = rows.repartitionByRange(
        int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "token", "id").sortWithinPartitions("token", "id")

    def live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield from filtered(held, before, batch.column(0)[0].as_py())
                before = held.column(0)[held.num_rows - 1].as_py()
            held = batch
        if held is not None:
            yield from filtered(held, before, None)

    def filtered(batch, before, after):
        t = np.asarray(batch.column(0))
        same = t[1:] == t[:-1]
        left = np.r_[before is None or t[0] == before, same]
        right = np.r_[same, after is None or t[-1] == after]
        yield batch.filter(pa.array(left | right))

    return spread.select("token", *[c for c in names if c != "token"]).mapInArrow(
        live, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spread.select("token", *[c for c in names if c != "token"]).schema))


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, end of each row's run): the sorted input in tables that end with a run of equal `keys`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        fresh = np.zeros(table.num_rows, bool)
        fresh[0] = True
        for k in keys:
            c = table[k].to_numpy()
            fresh[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(fresh)
        if len(starts) > 1:
            cut = int(starts[-1])
            yield table.slice(0, cut), np.repeat(starts[1:], np.diff(starts))
            held = table.slice(cut).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.full(table.num_rows, table.num_rows)


class Bitmaps:
    """Bitmaps of some rows, by size, with each folded to half its size for partners of that size."""

    def __init__(self, column: list[bytes]):
        self.size = np.array([len(b) for b in column], np.int64)
        self.place = np.zeros(len(column), np.int64)
        self.by_size: dict[int, np.ndarray] = {}
        for size in np.unique(self.size).tolist():
            rows = np.flatnonzero(self.size == size)
            self.place[rows] = np.arange(len(rows))
            self.by_size[size] = np.frombuffer(b"".join(column[i] for i in rows), np.uint64).reshape(len(rows), -1)
        self.halves = {s: m[:, :m.shape[1] // 2] ^ m[:, m.shape[1] // 2:] for s, m in self.by_size.items()}

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Differing bits of the pairs: at most the size of the sets' symmetric difference."""
        out = np.zeros(len(i), np.int64)
        for a in self.by_size:
            for b, left, right in ((a, self.by_size, self.by_size), (a * 2, self.by_size, self.halves), (a // 2, self.halves, self.by_size)):
                if b in self.by_size:
                    some = np.flatnonzero((self.size[i] == a) & (self.size[j] == b))
                    if len(some):
                        x = left[a][self.place[i[some]]] ^ right[b][self.place[j[some]]]
                        out[some] = np.bitwise_count(x).sum(axis=1)
        return out


def block_candidates(batches: Iterator[pa.RecordBatch], percent: int, orient, best: bool) -> Iterator[pa.RecordBatch]:
    """(id, other, apart): pairs of a block that pass every filter.

    `orient(table)` gives a function of row numbers (i, j) that returns those wanted, as (id row, other
    row). With `best` only each id's nearest partner within the slice is given.
    """
    for table, ends in whole_runs(batches, ["token", "tile"]):
        ids, n, pos = table["id"].to_numpy(), table["n"].to_numpy().astype(np.int64), table["pos"].to_numpy().astype(np.int64)
        maps, wanted = Bitmaps(table["bitmap"].to_pylist()), orient(table)
        partners = ends - np.arange(len(ids)) - 1
        bound = np.cumsum(partners)
        row = 0
        while row < len(ids):
            stop = max(row + 1, int(np.searchsorted(bound, (bound[row - 1] if row else 0) + PAIR_CHUNK, "right")))
            i = np.repeat(np.arange(row, stop), partners[row:stop])
            j = i + 1 + within(partners[row:stop])
            row = stop
            need = -(-(percent * (n[i] + n[j])) // (100 + percent))  # ⌈t / (1 + t) · (n₁ + n₂)⌉ shared elements
            ok = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (
                np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need)
            i, j = wanted(i[ok], j[ok])
            need = -(-(percent * (n[i] + n[j])) // (100 + percent))
            apart = maps.apart(i, j)
            ok = apart <= n[i] + n[j] - 2 * need
            one, two, apart = ids[i[ok]], ids[j[ok]], apart[ok]
            if best and len(one):
                order = np.lexsort((two, apart, one))
                head = order[np.r_[True, one[order[1:]] != one[order[:-1]]]]
                one, two, apart = one[head], two[head], apart[head]
            if len(one):
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(apart)], ["id", "other", "apart"])


def paired(rows: DataFrame, percent: int, orient, best: bool, tile: int = 2048) -> DataFrame:
    """(id, other) over `rows` (token, parts, id, n, pos, bitmap, ...): candidates within each token.

    A token held by more than `tile` rows is cut into `parts` by a hash of the id; part s goes to every
    tile {s, t}, so each pair of parts meets in one task of bounded size.
    """
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    least, most = (lambda t: F.least(t, F.col("part"))), (lambda t: F.greatest(t, F.col("part")))
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda t: least(t) * F.col("parts") + most(t))
    spread = rows.withColumn("part", part).withColumn("tile", F.explode(tiles)).drop("part", "parts")
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = spread.repartition(count, "token", "tile").sortWithinPartitions("token", "tile").mapInArrow(
        lambda b: block_candidates(b, percent, orient, best), "id bigint, other bigint, apart bigint")
    if not best:
        return found.select("id", "other").distinct()
    return found.groupBy("id").agg(F.min(F.struct("apart", "other")).alias("m")).select("id", F.col("m.other").alias("other"))


def packed(rows: DataFrame) -> DataFrame:
    """`rows` with their `text`, the last column, compressed as `blob`."""
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            blobs = pa.array([squeeze.compress(x.as_py().encode()) for x in batch.column(len(names))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], blobs], [*names, "blob"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema][:-1]
    return rows.mapInArrow(run, ", ".join([*kinds, "blob binary"]))


def stored_texts(texts: DataFrame) -> DataFrame:
    """(id, blob) written as a table bucketed by id: the rounds of verification join it unshuffled."""
    spark = texts.sparkSession
    parts, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"set_join_{uuid.uuid4().hex}"
    once = texts.repartition(parts, "id").groupBy("id").agg(F.first("blob").alias("blob"))
    once.write.bucketBy(parts, "id").format("parquet").option("path", f"{shared_dir(spark)}/{name}").option(
        "compression", "none").saveAsTable(name)
    return spark.table(name)


def jaccard_of_texts(pairs: DataFrame, texts: DataFrame, size: int | Callable[[Words], Sets], percent: int) -> DataFrame:
    """(a, b) of the pairs whose sets have Jaccard `percent` or more, from their whole texts.

    The sets are shingles of `size` words, or what the function `size` makes of the words.

    Both texts of a pair meet by the pair, never by a text, so a text in many pairs is no hot key.
    """
    asked = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("id"))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = asked.join(texts, "id").select("a", "b", "id", "blob").repartition(parts, "a", "b").sortWithinPartitions("a", "b", "id")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = None
        for batch in batches:
            if odd is not None:
                batch = pa.Table.from_batches([odd, batch]).combine_chunks().to_batches()[0]
                odd = None
            even = batch.num_rows // 2 * 2
            if even < batch.num_rows:
                odd = batch.slice(even)
            batch, restore = batch.slice(0, even), zstandard.ZstdDecompressor()
            texts = pa.array([restore.decompress(x) for x in batch.column(3).to_pylist()], pa.large_binary()).cast(pa.large_string())
            at = 0
            while at < even:
                _, stop, _, _ = next(slices(texts.slice(at), CHECKED_BYTES))
                stop = at + max(2, stop // 2 * 2)
                part = batch.slice(at, stop - at)
                _, _, data, offsets = next(slices(texts.slice(at, stop - at), 1 << 62))
                words = Words(data, offsets)
                sets = shingle_sets(words, size) if isinstance(size, int) else size(words)
                both = sets.row // 2
                order = row_order(both, 0, sets.hash)
                h, p = sets.hash[order], both[order]
                shared = np.bincount(p[1:][(h[1:] == h[:-1]) & (p[1:] == p[:-1])], minlength=len(sets.n) // 2)
                total = sets.n[0::2] + sets.n[1::2] - shared
                good = (100 * shared >= percent * total) & (shared > 0)
                yield part.take(pa.array(np.flatnonzero(good) * 2)).select(["a", "b"])
                at = stop

    return together.mapInArrow(check, "a bigint, b bigint")
