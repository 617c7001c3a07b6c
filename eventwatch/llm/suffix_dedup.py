"""Removal of repeated 100-byte strings by a depth-limited radix sort of suffixes (operator 1).

Suffixes are ordered by most-significant-digit passes and only as deep as the threshold. A pass sees a
run of neighbouring suffixes as one row with two digits: `core`, the bytes all strings of the run have
in common, and `hull`, the bytes that all of them together span. Sorting by (core, hull, place) groups
them: a core met once ends its run (nothing in it repeats); equal hulls repeat string by string, so all
but the first are repeats; several hulls under one core go to the next pass in shorter runs. The last
pass has one string per row, where core and hull are the whole 100 bytes and equal groups are exactly
the repeated windows.

The first runs are given by content: of the 32-byte cores inside a string the one with the smallest
hash is its anchor, and neighbouring strings with one anchor form a run. Equal strings have the same
anchor at the same distance, so they meet in every pass.

Digits are 64-bit hashes (a pair of them decides equality). Each pass is one range-partitioned sort:
a repeated core or hull that fills a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from eventwatch.llm.text_arrays import RADIX, RADIX_INVERSE, id_and_text, mix, powers_of, signed, slices, within
from eventwatch.session import materialize, shared_dir

LENGTH = 100
CORE = 32
#: Strings per run in the second pass.
CELL = 8
_PLACE_BITS = 24
_BLOCK = 1 << 23
#: A document id, null as the smallest, and 15 bits of its text's hash above a place of 48 bits.
_NULL_ID = -(1 << 63)
_PLACE = (1 << 48) - 1
ROW = "core bigint, hull bigint, doc bigint, at bigint"


class Hashes:
    """64-bit hashes of byte ranges (8 bytes or more) of one slice, from one running sum of 8-byte mixes."""

    def __init__(self, data: np.ndarray):
        n = max(len(data) - 7, 0)
        grams = np.lib.stride_tricks.as_strided(np.ascontiguousarray(data), (n, 8), (1, 1)).copy().view(np.uint64).ravel() if n else np.zeros(0, np.uint64)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(grams) * powers_of(RADIX, n + 1)[:-1], out=self.total[1:])
        self.inverse = powers_of(RADIX_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        value = (self.total[end - 7] - self.total[start]) * self.inverse[start]
        return mix(value ^ mix(((end - start) + np.asarray(salt, np.int64) * 1024).astype(np.uint64)))


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    n, have, out = len(x) - width + 1, 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:n], out[width - have:width - have + n])


class Runs:
    """The runs of a slice: anchor place, row, and first and last string start of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.hashes = Hashes(data)
        n, width = len(data), LENGTH - CORE + 1
        starts, chosen = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        low = np.uint64((1 << _PLACE_BITS) - 1)
        for s in range(0, n - LENGTH + 1, _BLOCK):
            place = np.arange(s, min(s + _BLOCK, n - LENGTH + 1) + width - 1)
            key = (self.hashes.of(place, place + CORE) & ~low) | (place - s).astype(np.uint64)
            least = (sliding_minimum(key, width) & low).astype(np.int64) + s
            starts.append(np.arange(s, s + len(least)))
            chosen.append(least)
        start, anchor = np.concatenate(starts), np.concatenate(chosen)
        row = np.searchsorted(offsets, start, "right") - 1
        inside = start + LENGTH <= offsets[row + 1]
        start, anchor, row = start[inside], anchor[inside], row[inside]
        head = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]) if len(start) else np.zeros(0, np.int64)
        self.anchor, self.row, self.lo = anchor[head], row[head], start[head]
        self.hi = start[np.r_[head[1:] - 1, len(start) - 1]] if len(head) else self.lo

    def digits(self) -> tuple[np.ndarray, np.ndarray]:
        core = self.hashes.of(self.anchor, self.anchor + CORE)
        hull = self.hashes.of(self.lo, self.hi + LENGTH, (self.anchor - self.lo) * 128 + self.hi - self.lo)
        return core, hull

    def find(self, anchors: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.anchor, anchors)

    def cells(self, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(run, cell number, first start, last start): parts of the runs by distance to the anchor."""
        first, last = (self.anchor[run] - self.hi[run]) // CELL, (self.anchor[run] - self.lo[run]) // CELL
        many = last - first + 1
        run, cell = np.repeat(run, many), np.repeat(first, many) + within(many)
        return run, cell, *self.cell_bounds(run, cell)

    def cell_bounds(self, run: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = self.anchor[run]
        return np.maximum(self.lo[run], a - CELL * cell - CELL + 1), np.minimum(self.hi[run], a - CELL * cell)

    def cell_digits(self, run: np.ndarray, cell: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = self.anchor[run]
        core = self.hashes.of(a - CELL * cell, a - CELL * cell - CELL + 1 + LENGTH, cell + 1)
        hull = self.hashes.of(lo, hi + LENGTH, ((a - lo) * 128 + hi - lo) * 16 + cell + 1)
        return core, hull


def first_digits(docs: DataFrame) -> DataFrame:
    """One row per run of every document, read straight from the table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            for i, j, data, offsets in slices(batch.column(1)):
                runs = Runs(data, offsets)
                core, hull = runs.digits()
                at = (marks[i:j][runs.row] << 48) | (runs.anchor - offsets[runs.row])
                yield _rows(core, hull, ids[i:j][runs.row], at)

    return keyed(docs).mapInArrow(run, ROW)


def _rows(core, hull, doc, at) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(signed(core)), pa.array(signed(hull)), pa.array(doc, pa.int64()), pa.array(at, pa.int64())],
                                      ["core", "hull", "doc", "at"])


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, text, mark): the id with null as smallest, and 15 bits of the text's hash."""
    read = id_and_text(docs)
    return read.select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc"), "text",
                       F.shiftrightunsigned(F.xxhash64("text"), 49).alias("mark"))


def digit_pass(rows: DataFrame) -> DataFrame:
    """(doc, at, repeat): repeat true where a row's strings all occur earlier, false where undecided.

    Runs that repeat nothing give no row. Rows equal in everything are one place of repeated documents
    and no repeat of each other; they meet in one partition. The first and last class of a partition count as undecided,
    because their neighbours are elsewhere; the next pass settles them.
    """
    order = ["core", "hull", "doc", "at"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda doc, at, repeat: pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array(repeat, pa.bool_())], ["doc", "at", "repeat"])
        last, head, several = None, None, True  # last (core, hull); first row of the class now open
        for batch in batches:
            if not batch.num_rows:
                continue
            core, hull, doc, at = (np.asarray(batch.column(k)) for k in range(4))
            fresh = np.ones(len(core), bool)
            fresh[1:] = (core[1:] != core[:-1]) | (hull[1:] != hull[:-1])
            if last is not None:
                fresh[0] = (core[0], hull[0]) != last
            f = np.flatnonzero(fresh)
            # the head of each row's class; -1 is the class open from the batch before
            lead = np.cumsum(fresh) - 1
            heads_doc, heads_at = np.r_[doc[f], head[0] if head else 0], np.r_[at[f], head[1] if head else 0]
            old = np.flatnonzero(~fresh & ((doc != heads_doc[lead]) | (at != heads_at[lead])))
            if len(old):
                yield out(doc[old], at[old], np.ones(len(old), bool))
            if len(f):
                # the open class from before, then all but the last class of this batch, have a known follower
                same = np.zeros(len(f), bool)  # a class's core equals the one before it
                same[1:] = core[f[1:]] == core[f[:-1]]
                if head is not None:
                    same[0] = core[f[0]] == last[0]
                    if several or same[0]:
                        yield out([head[0]], [head[1]], [False])
                else:
                    same[0] = True  # the partition's first class
                multi = same.copy()
                multi[:-1] |= same[1:]
                sent = f[:-1][multi[:-1]]
                if len(sent):
                    yield out(doc[sent], at[sent], np.zeros(len(sent), bool))
                head, several = (int(doc[f[-1]]), int(at[f[-1]])), bool(same[-1])
            last = (core[-1], hull[-1])
        if head is not None:
            yield out([head[0]], [head[1]], [False])

    return spread.mapInArrow(run, "doc bigint, at bigint, repeat boolean")


# --- documents kept by id for the later passes ------------------------------------------------------

def stored_by_id(docs: DataFrame) -> DataFrame:
    """Texts, compressed, in a table bucketed by document, so that no later pass shuffles them."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            blobs = [squeeze.compress(x.as_py().encode()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(blobs, pa.binary())], ["doc", "mark", "blob"])

    spark = docs.sparkSession
    parts, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"suffix_dedup_{uuid.uuid4().hex}"
    packed = keyed(docs).mapInArrow(pack, "doc bigint, mark bigint, blob binary")
    packed.repartition(parts, "doc", "mark").write.bucketBy(parts, "doc", "mark").format("parquet").option(
        "path", f"{shared_dir(spark)}/{name}").option("compression", "none").saveAsTable(name)
    return spark.table(name)


def with_places(stored: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The stored documents with the sorted places that `rows` (doc, at) hold for them."""
    each = rows.select("doc", F.shiftrightunsigned("at", 48).alias("mark"), F.col("at").bitwiseAND(_PLACE).alias("place"))
    lists = each.groupBy("doc", "mark").agg(F.collect_list("place").alias("places"))
    return stored.join(lists, ["doc", "mark"], how).select("doc", "mark", "blob", "places")


def opened(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(first row, end row, bytes, offsets, row and value of every place) for parts of a batch."""
    restore = zstandard.ZstdDecompressor()
    texts = pa.array([restore.decompress(b.as_py()).decode() for b in batch.column(2)], pa.large_string())
    for i, j, data, offsets in slices(texts):
        part = batch.column(3).slice(i, j - i)
        counts = np.array([len(x) if x.is_valid else 0 for x in part], np.int64)
        yield i, j, data, offsets, np.repeat(np.arange(j - i), counts), part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def second_digits(stored: DataFrame, undecided: DataFrame) -> DataFrame:
    """Cells of the undecided runs; a place is anchor · 16 + cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for i, j, data, offsets, row, place in opened(batch):
                runs = Runs(data, offsets)
                which, cell, lo, hi = runs.cells(np.unique(runs.find(offsets[row] + place)))
                core, hull = runs.cell_digits(which, cell, lo, hi)
                r = runs.row[which]
                at = (marks[i:j][r] << 48) | ((runs.anchor[which] - offsets[r]) * 16 + cell)
                yield _rows(core, hull, ids[i:j][r], at)

    return with_places(stored, undecided, "inner").mapInArrow(run, ROW)


def last_digits(stored: DataFrame, undecided: DataFrame) -> DataFrame:
    """Single strings of the undecided cells: both digits are hashes of the whole string."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for i, j, data, offsets, row, place in opened(batch):
                runs = Runs(data, offsets)
                lo, hi = runs.cell_bounds(runs.find(offsets[row] + place // 16), place % 16)
                start = np.unique(np.repeat(lo, hi - lo + 1) + within(hi - lo + 1))
                r = np.searchsorted(offsets, start, "right") - 1
                yield _rows(runs.hashes.of(start, start + LENGTH), runs.hashes.of(start + 1, start + LENGTH, 7), ids[i:j][r],
                            (marks[i:j][r] << 48) | (start - offsets[r]))

    return with_places(stored, undecided, "inner").mapInArrow(run, ROW)


def repeated_strings(rows: DataFrame) -> DataFrame:
    """Rows of the last pass that are not the first with their digits."""
    first = rows.groupBy("core", "hull").agg(F.min(F.struct("doc", "at")).alias("first"), F.count(F.lit(1)).alias("held")).filter("held > 1")
    met = rows.join(first.select("core", "hull", "first"), ["core", "hull"])
    return met.filter((F.col("doc") != F.col("first.doc")) | (F.col("at") != F.col("first.at"))).select("doc", "at")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text (bytes left, may break characters), n_bytes, n_removed, n_spans, spans per document.

    Null and empty texts and texts under 100 bytes lose nothing. Of equal strings the one with the
    smallest (doc_id, start) stays, null ids first. Rows equal in doc_id and text are one document and
    get the same result; rows with one doc_id and different texts are ordered by a hash of the text.
    Other columns are ignored; an empty table gives no rows.
    """
    found = materialize(digit_pass(first_digits(docs)), "suffix-runs")
    stored = stored_by_id(docs)
    cells = materialize(second_digits(stored, found.filter("not repeat")), "suffix-cells")
    found_cells = materialize(digit_pass(cells), "suffix-cells-found")
    strings = materialize(last_digits(stored, found_cells.filter("not repeat")), "suffix-strings")
    # three kinds of place in one list: run, cell, string
    kind = lambda df, k: df.select("doc", F.col("at").bitwiseAND(~_PLACE).bitwiseOR(
        F.col("at").bitwiseAND(_PLACE) * 4 + k).alias("at"))
    gone = kind(found.filter("repeat"), 0).union(kind(found_cells.filter("repeat"), 1)).union(kind(repeated_strings(strings), 2))

    def parted(batch: pa.RecordBatch) -> Iterator[tuple]:
        """Documents that lose nothing apart from the others: their runs are not needed."""
        whole = batch.column(3).is_null()
        for part in (batch.filter(whole), batch.filter(pc.invert(whole))):
            for slice_ in opened(part):
                yield *slice_, part.column(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets, row, place, ids in parted(batch):
                what, value, base = place % 4, place // 4, offsets[row]
                lo = hi = np.zeros(0, np.int64)
                if (what < 2).any():
                    runs = Runs(data, offsets)
                    r = runs.find(base[what == 0] + value[what == 0])
                    c = runs.find(base[what == 1] + value[what == 1] // 16)
                    lo, hi = runs.cell_bounds(c, value[what == 1] % 16)
                    lo, hi = np.r_[runs.lo[r], lo], np.r_[runs.hi[r], hi]
                s = base[what == 2] + value[what == 2]
                n = len(data)
                step = np.bincount(np.r_[lo, s], minlength=n + 1) - np.bincount(
                    np.r_[hi, s] + LENGTH, minlength=n + 1)
                covered = np.cumsum(step)[:n] > 0
                opens = covered.copy()
                opens[1:] &= ~covered[:-1]
                heads = offsets[:-1][np.diff(offsets) > 0]
                opens[heads] = covered[heads]
                closes = covered.copy()
                closes[:-1] &= ~covered[1:] | opens[1:]
                a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
                at = np.searchsorted(a, offsets)
                left = np.r_[0, np.cumsum(~covered)][offsets]
                kept = data[~covered].tobytes()
                yield pa.RecordBatch.from_arrays([
                    ids.slice(i, j - i), pa.array([kept[x:y] for x, y in zip(left, left[1:])], pa.binary()),
                    pa.array(np.diff(offsets)), pa.array(np.diff(offsets) - np.diff(left)), pa.array(np.diff(at)),
                    pa.array([[{"start": int(x - offsets[k]), "end": int(y - offsets[k])} for x, y in zip(a[at[k]:at[k + 1]], b[at[k]:at[k + 1]])]
                              for k in range(j - i)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    ["doc", "kept", "n_bytes", "n_removed", "n_spans", "spans"])

    out = with_places(stored, gone, "left").mapInArrow(
        run, "doc bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start:bigint,end:bigint>>")
    return out.select(F.when(F.col("doc") != _NULL_ID, F.col("doc")).alias("doc_id"), "kept", "n_bytes", "n_removed", "n_spans", "spans")
