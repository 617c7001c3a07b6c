"""Benchmark decontamination by SimHash of item-sized windows (operator 4).

Every window of a document as long as an item gets a 64-bit SimHash of its weighted five-word
shingles. Fingerprints are cut into blocks; whatever lies within `RADIUS` bits of an item's
fingerprint differs by at most RADIUS // BLOCKS bits in some block, so looking up each block with
that many flips finds every such item. Candidates are verified by exact weighted Jaccard.

A window alike in 0.8 of its shingles shares at least one with the item, so every window that holds a
shared shingle is fingerprinted, whatever the order of the item's parts in it. Bits are summed along
stretches of neighbouring windows. Documents are read once and nothing is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from eventwatch.llm.text_arrays import NOT_LETTERS, Words, id_and_text, shingles, slices, small_batches, within

SHINGLE = 5
PERCENT = 80
RADIUS = 20
BLOCKS = 8
#: Windows and shingles of stretches whose bits a task sums at a time.
STRETCH = 1 << 17
#: Item text that travels to every task at a time; a larger benchmark is used in parts of this size.
PART_BYTES = 8 << 20


class Benchmark:
    """Index over one part of the benchmark: shingles, fingerprints and block tables."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = ids
        raw = [t.lower().encode() for t in texts]
        offsets = np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)
        words = Words(np.frombuffer(b"".join(raw), np.uint8), offsets, breaks=NOT_LETTERS)
        h, row = shingles(words, SHINGLE)
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
        self.size = np.diff(words.first)
        self.count = np.bincount(row, minlength=len(ids))
        self.first = np.cumsum(self.count) - self.count
        self.bags = [Counter(h[a:a + n].tolist()) for a, n in zip(self.first, self.count)]
        by_hash = np.argsort(h, kind="stable")
        self.hash, self.item, self.place = h[by_hash], row[by_hash], (np.arange(len(h)) - self.first[row])[by_hash]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(h >> np.uint64(44)).astype(np.int64)] = True
        self.prints = np.array([fingerprint(h[a:a + n]) for a, n in zip(self.first, self.count)], np.uint64)
        # per block and block value the items within the flips that the radius leaves for one block
        width, flips = 64 // BLOCKS, RADIUS // BLOCKS
        values = np.arange(1 << width, dtype=np.uint64)
        self.tables = [
            np.bitwise_count(values[:, None] ^ block_of(self.prints, b)[None, :]) <= flips for b in range(BLOCKS)]


def block_of(prints: np.ndarray, b: int) -> np.ndarray:
    width = 64 // BLOCKS
    return (prints >> np.uint64(width * b)) & np.uint64((1 << width) - 1)


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash: each bit is the majority over the shingles, repeated ones counted each time."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(np.ascontiguousarray(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").view(np.uint64)[0])


def near_items(bench: Benchmark, prints: np.ndarray) -> np.ndarray:
    """(windows, items) matrix: fingerprints within RADIUS, found through the block tables."""
    near = np.zeros((len(prints), len(bench.ids)), bool)
    for b, table in enumerate(bench.tables):
        near |= table[block_of(prints, b).astype(np.int64)]
    w, k = np.nonzero(near)
    near[w, k] = np.bitwise_count(prints[w] ^ bench.prints[k]) <= RADIUS
    return near


def weighted_jaccard(a: Counter, b: Counter) -> tuple[int, int]:
    shared = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return shared, a.total() + b.total() - shared


def windows_over(row: np.ndarray, size: np.ndarray, place: np.ndarray, most: np.ndarray) -> np.ndarray:
    """(row, size, start), sorted and distinct: every window of `size` words over the shingle at word `place`.

    Starts lie between 0 and `most`.
    """
    row, size, place, most = np.unique(np.c_[row, size, place, most], axis=0).T
    lo = np.minimum(np.maximum(place - np.maximum(size - SHINGLE, 0), 0), most)
    hi = np.minimum(place, most)
    # both ends grow along a row and size: each shingle adds the starts after those of the one before
    same = (row[1:] == row[:-1]) & (size[1:] == size[:-1])
    lo[1:] = np.where(same, np.maximum(lo[1:], hi[:-1] + 1), lo[1:])
    many = np.maximum(hi - lo + 1, 0)
    return np.c_[np.repeat(row, many), np.repeat(size, many), np.repeat(lo, many) + within(many)]


def window_prints(h: np.ndarray, at: np.ndarray, n: np.ndarray, head: np.ndarray) -> np.ndarray:
    """SimHash of h[at:at + n] for windows in stretches: from `head` on, each starts one after the last."""
    heads = np.flatnonzero(head)
    length = np.diff(np.r_[heads, len(at)])
    span = length + n[heads] - 1
    bits = np.unpackbits(h[np.repeat(at[heads], span) + within(span)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.zeros((len(bits) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=total[1:])
    first = np.repeat(np.cumsum(span) - span, length) + within(length)
    return np.packbits(2 * (total[first + n] - total[first]) > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def leaks(data: np.ndarray, offsets: np.ndarray, bench: Benchmark) -> list[tuple[int, int, int, int, float]]:
    """(row, item, first word, words, similarity): each leaked item's best window per row."""
    words = Words(data, offsets, breaks=NOT_LETTERS)
    counts = np.diff(words.first)
    h, row = shingles(words, SHINGLE)
    order = np.argsort(row, kind="stable")
    h, row = h[order], row[order]
    held = np.bincount(row, minlength=len(counts))
    first = np.cumsum(held) - held
    hit = np.flatnonzero(bench.maybe[(h >> np.uint64(44)).astype(np.int64)])
    lo, hi = np.searchsorted(bench.hash, h[hit], "left"), np.searchsorted(bench.hash, h[hit], "right")
    hit, lo, many = hit[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
    if not len(hit):
        return []
    at = np.repeat(lo, many) + within(many)
    where = np.repeat(hit, many)
    r, item = row[where], bench.item[at]
    size = bench.size[item]
    r, size, start = windows_over(r, size, where - first[r], np.maximum(counts[r] - size, 0)).T
    n = np.maximum(np.minimum(size, counts[r]) - SHINGLE + 1, 1)
    a = first[r] + start
    head = np.r_[True, (r[1:] != r[:-1]) | (size[1:] != size[:-1]) | (start[1:] != start[:-1] + 1)]
    weight = np.cumsum(np.where(head, n, 1))
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    step = max(1, (8 << 20) // max(len(bench.ids), 64))
    i = 0
    while i < len(a):
        j = min(i + step, max(i + 1, int(np.searchsorted(weight, weight[i] + STRETCH, "right"))))
        head[i] = True
        prints = window_prints(h, a[i:j], n[i:j], head[i:j])
        near, i = np.argwhere(near_items(bench, prints)) + [i, 0], j
        for w, k in near.tolist():
            bag = Counter(h[a[w]:a[w] + n[w]].tolist())
            shared, total = weighted_jaccard(bag, bench.bags[k])
            if shared and 100 * shared >= PERCENT * total:
                key, new = (int(r[w]), int(k)), (shared / total, -int(start[w]), int(min(size[w], counts[r[w]])))
                found[key] = max(found.get(key, new), new)
    return [(r, k, -s, n, value) for (r, k), (value, s, n) in sorted(found.items())]


def benchmark_parts(items: DataFrame, limit: int = PART_BYTES) -> Iterator[Benchmark]:
    """The benchmark in parts of about `limit` bytes, each small enough to travel to every task."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // limit))
    for part in range(parts):
        chosen = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        rows = sorted((r.item_id if r.item_id is not None else -1, r.text, r.item_id) for r in chosen.distinct().collect())
        bench = Benchmark([r[2] for r in rows], [r[1] for r in rows])
        if len(bench.ids):
            yield bench


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: one row per document row and leaked item.

    Words are runs of letters, digits, apostrophes and non-ASCII characters, in lower case. Null and empty texts and items without words match nothing; items or documents of fewer
    than five words are one shingle. Of equally good windows the first is given. Equal items are one;
    clean documents give no row; other columns are ignored; an empty table on either side gives none.
    """
    read, out = id_and_text(docs), None
    schema = "doc_id bigint, item_id bigint, similarity double, first_word int, n_words int"
    for bench in benchmark_parts(items):
        def run(batches: Iterator[pa.RecordBatch], bench: Benchmark = bench) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                for i, _, data, offsets in slices(pc.utf8_lower(batch.column(1))):
                    got = leaks(data, offsets, bench)
                    yield pa.RecordBatch.from_arrays([
                        ids.take(pa.array([i + g[0] for g in got], pa.int64())), pa.array([bench.ids[g[1]] for g in got], pa.int64()),
                        pa.array([g[4] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int32()),
                        pa.array([g[3] for g in got], pa.int32())], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        part = read.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs`, all their columns, in which no item of the benchmark was found."""
    small_batches(docs.sparkSession)
    place = docs.columns.index("text")
    for bench in benchmark_parts(items):
        def run(batches: Iterator[pa.RecordBatch], bench: Benchmark = bench) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, data, offsets in slices(pc.utf8_lower(batch.column(place))):
                    clean = np.ones(j - i, bool)
                    clean[[g[0] for g in leaks(data, offsets, bench)]] = False
                    yield batch.slice(i, j - i).filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
