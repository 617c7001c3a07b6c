"""Line deduplication by an exact set-similarity join (operator 10).

A line's set is its words, A-Z in lower case, repeated words told apart by number (the second "the" is
another element than the first). A line goes when any line before it (smaller doc_id, or earlier in the
same document) has Jaccard 0.8 or more with it; matches are judged on the input.

Words are ordered by rarity. Lines with equal sets form a class, represented by its first line. Two
classes can only match when they share an element of both prefixes; rows (element, class) meet by the
element and pass the length, positional and bitmap filters, none of which loses a match. What is left is
verified from the whole lines. A class needs one earlier match only, so each first tries the nearest of
its candidates in a block; a class that had more and found none tries all of them. The rows of an
element held by very many classes are cut into tiles, so no task sees more than two parts of `TILE`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from eventwatch.llm import set_join as sj
from eventwatch.llm.text_arrays import Words, id_and_text, lists, mix, signed, slices, within
from eventwatch.session import larger_batches, materialize

PERCENT = 80
TILE = 2048
#: Candidates a class tries first, in each step of a block; the others follow if none of these matches.
NEAREST = 8
#: Words are counted in this many hash buckets. The counts order words and mark those that may be hot.
BUCKETS = 1 << 17
#: Rows of a block partition a task looks at together.
GATHERED = 1 << 17
#: Bytes of text whose words are taken at once: small enough for a core's cache.
SLICE_BYTES = 1 << 18
_NTH = np.uint64(0x9E3779B97F4A7C15)


def with_body(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).withColumn("body", F.xxhash64("text"))


def words_of_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words by line, row of each line's text, number of the line in it); empty last lines are left out."""
    breaks = np.flatnonzero(data == 10) + 1
    starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks[breaks < len(data)]) if len(data) else np.zeros(0, np.int64)
    row = np.searchsorted(offsets, starts, "right") - 1
    # a break that ends a document opens no line of the next one twice: starts are distinct
    number = np.searchsorted(breaks, starts, "right") - np.searchsorted(breaks, offsets[row], "right")
    return Words(data, np.r_[starts, len(data)].astype(np.int64)), row, number


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def word_counts(docs: DataFrame) -> np.ndarray:
    """Count per bucket of the words of all lines, lines with the same words counted once a slice.

    A task sends at most one row a bucket, and `BUCKETS` numbers come to the driver, however large the corpus.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(1), SLICE_BYTES):
                words = words_of_lines(data, offsets)[0]
                sizes = np.diff(words.first)
                some = np.flatnonzero(sizes)
                if len(some):
                    place = within(sizes).astype(np.uint64)
                    key = np.add.reduceat(mix(words.hash + place * _NTH), words.first[some])
                    fresh = np.zeros(len(sizes), bool)
                    fresh[some[np.unique(key, return_index=True)[1]]] = True
                    total += np.bincount(_bucket(words.hash[np.repeat(fresh, sizes)]), minlength=BUCKETS)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met])], ["bucket", "n"])

    got = id_and_text(docs).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[got.bucket.to_numpy(np.int64)] = got.n.to_numpy(np.int64)
    return out


def token_sets(words: Words, level: np.ndarray | int = 0) -> tuple[sj.Sets, np.ndarray]:
    """(the rows' elements, level of each), ordered by `level`, below 128 and the same for equal words, and word."""
    row = words.row
    order = sj.row_order(row, level if np.isscalar(level) else level.astype(np.uint64), words.hash)
    h = words.hash[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    place = np.arange(len(h))
    nth = place - np.maximum.accumulate(np.where(again, 0, place)) if len(h) else place
    found = np.broadcast_to(level, len(h))[order]
    return sj.Sets(mix(h + nth.astype(np.uint64) * _NTH), row, np.diff(words.first).astype(np.int64)), found


def line_classes(docs: DataFrame, percent: int, counts: np.ndarray) -> DataFrame:
    """One row per class of lines with equal sets: its first line (doc_id, line, body), n, prefix, tail, b1, b2.

    `prefix` and, after it, `tail` have 32 bits of each element; those of `prefix` are in too few lines to
    need tiles. b1 and b2 are a parity bitmap of 128 bits.
    """
    levels = np.ceil(2 * np.log2(counts + 1)).astype(np.uint8)
    hot = np.ceil(2 * np.log2(TILE + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, offsets in slices(batch.column(1), SLICE_BYTES):
                words, row, number = words_of_lines(data, offsets)
                sets, level = token_sets(words, levels[_bucket(words.hash)])
                some = np.flatnonzero(sets.n)
                if not len(some):
                    continue
                n, heads, e = sets.n[some], words.first[:-1][some], sets.hash
                size = sj.prefix_length(n, percent)
                at = np.repeat(heads, size) + within(size)
                cold, short = level[at] < hot, (e[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                few = np.bincount(np.repeat(np.arange(len(n)), size)[cold], minlength=len(n))
                bit, high = np.uint64(1) << (e & np.uint64(63)), (e & np.uint64(64)) > 0
                columns = [
                    signed(np.add.reduceat(mix(e + np.uint64(1)), heads)),
                    signed(np.add.reduceat(mix(e ^ np.uint64(0x5851F42D4C957F2D)), heads)),
                    batch.column(0).take(pa.array(row[some] + i)), pa.array(number[some], pa.int32()),
                    batch.column(2).take(pa.array(row[some] + i)), pa.array(n, pa.int32()),
                    lists(short[cold], few, pa.int32()), lists(short[~cold], size - few, pa.int32()),
                    signed(np.bitwise_xor.reduceat(np.where(high, bit, np.uint64(0)), heads)),
                    signed(np.bitwise_xor.reduceat(np.where(high, np.uint64(0), bit), heads))]
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c) for c in columns],
                    ["k1", "k2", "doc_id", "line", "body", "n", "prefix", "tail", "b1", "b2"])

    lines = with_body(docs).select("doc_id", "text", "body").mapInArrow(
        run, "k1 bigint, k2 bigint, doc_id bigint, line int, body bigint, n int, prefix array<int>, tail array<int>, b1 bigint, b2 bigint")
    # the place decides the minimum; what follows it is equal within a class
    first = F.min(F.struct("doc_id", "line", "body", "n", "prefix", "tail", "b1", "b2")).alias("first")
    return lines.groupBy("k1", "k2").agg(first).select(F.monotonically_increasing_id().alias("id"), "first.*")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in larger batches, with the token in a column of its own."""
    def whole():
        table = pa.Table.from_batches(held).combine_chunks()
        return table.append_column("token", pa.array(table["key"].to_numpy() >> 32)).to_batches()

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= GATHERED:
            yield from whole()
            held, rows = [], 0
    if held:
        yield from whole()


def _block_pairs(batches: Iterator[pa.RecordBatch], percent: int, every: bool) -> Iterator[pa.RecordBatch]:
    """(id, other, more): earlier candidates of classes in a block; `more` where the nearest are not all.

    With `every`, all candidates of the rows marked `open`.
    """
    low = (1 << 32) - 1
    for table, ends in sj.whole_runs(_gathered(batches), ["token"]):
        c = {k: table[k].to_numpy() for k in table.column_names if k != "doc_id"}
        ids, n, line, pos = c["id"], c["key"] & low, c["place"] >> 32, c["place"] & low
        # as unsigned: numpy counts the bits of a negative number's absolute value
        maps = [np.ascontiguousarray(c[k]).view(np.uint64) for k in ("b1", "b2")]
        # a block is sorted by size: the partners of a row are the larger ones up to its length limit
        key = ends * (int(n.max()) + 1) + n
        limit = ends * (int(n.max()) + 1) + np.minimum(100 * n // percent, n.max())
        partners = np.searchsorted(key, limit, "right") - np.arange(len(ids)) - 1
        # a row too far behind in its prefix to share enough with any larger one has none
        partners[n - pos < -(-(2 * percent * n) // (100 + percent))] = 0
        bound = np.cumsum(partners)
        row = 0
        while row < len(ids):
            stop = max(row + 1, int(np.searchsorted(bound, (bound[row - 1] if row else 0) + sj.PAIR_CHUNK, "right")))
            i = np.repeat(np.arange(row, stop), partners[row:stop])
            j = i + 1 + within(partners[row:stop])
            row = stop
            need = -(-(percent * (n[i] + n[j])) // (100 + percent))  # ⌈t / (1 + t) · (n₁ + n₂)⌉ shared elements
            ok = np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need
            i, j, need = i[ok], j[ok], need[ok]
            apart = sum(np.bitwise_count(m[i] ^ m[j]).astype(np.int64) for m in maps)
            # a class holds an element once, but two elements may share their 32 bits
            ok = (apart <= n[i] + n[j] - 2 * need) & (ids[i] != ids[j])
            i, j, apart = i[ok], j[ok], apart[ok]
            # the few rows left are ordered by place
            rows, at = np.unique(np.r_[i, j], return_inverse=True)
            doc = table["doc_id"].take(pa.array(rows)).fill_null(-(1 << 63)).to_numpy()
            rank = np.empty(len(rows), np.int64)
            rank[np.lexsort((ids[rows], c["b2"][rows], c["b1"][rows], line[rows], doc))] = np.arange(len(rows))
            first, second = rank[at[:len(i)]], rank[at[len(i):]]
            late, early, before = np.where(first < second, j, i), np.where(first < second, i, j), np.minimum(first, second)
            more = np.zeros(len(late), bool)
            if every:
                ok = c["open"][late]
                late, early, more = late[ok], early[ok], more[ok]
            elif len(late):
                o = np.lexsort((before, apart, late))
                late, early = late[o], early[o]
                size = np.diff(np.flatnonzero(np.r_[True, late[1:] != late[:-1], True]))
                keep = within(size) < NEAREST
                more = np.repeat(size > NEAREST, size)[keep]
                late, early = late[keep], early[keep]
            if len(late):
                yield pa.RecordBatch.from_arrays([pa.array(ids[late]), pa.array(ids[early]), pa.array(more)], ["id", "other", "more"])


def candidates(reps: DataFrame, hot: DataFrame, percent: int, undecided: DataFrame | None = None) -> DataFrame:
    """(id, other, more): pairs of classes that pass every filter, `other` being the earlier one.

    Without `undecided` the nearest of each class, with it all candidates of these classes.
    """
    every, kept = undecided is not None, ["id", "doc_id", "line", "n", "b1", "b2"]
    if every:
        marked = undecided.withColumn("open", F.lit(True))
        reps, kept = reps.join(marked, "id", "left").withColumn("open", F.coalesce("open", F.lit(False))), [*kept, "open"]
    rows = reps.select(*kept, F.posexplode(F.concat("prefix", "tail")).alias("pos", "token"))
    if every:
        # partners of an open class share an element with it and lie within its length limits; a written
        # table has a known size: where the open classes are few, the rows are not shuffled for them
        asked = rows.filter("open").groupBy(F.col("token").alias("asked")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
        near = (100 * F.col("n") >= percent * F.col("least")) & (percent * F.col("n") <= 100 * F.col("most"))
        rows = rows.join(materialize(asked, "line-asked"), (F.col("token") == F.col("asked")) & near, "left_semi")
    # part s of a hot element goes to every tile {s, t}, so each pair of parts meets in one task
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1),
                        lambda t: F.least(t, part) * F.col("parts") + F.greatest(t, part))
    rows = rows.join(hot, "token", "left").withColumn(
        "tile", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(tiles))).withColumn(
        "token", F.when(F.col("parts").isNull(), F.col("token")).otherwise(F.hash("token", "tile")))
    # blocks of one number only give more candidates; Spark sorts by one long without comparing rows
    high = lambda a, b: (F.shiftleft(F.col(a).cast("long"), 32) + F.col(b)).alias
    rows = rows.select(high("token", "n")("key"), high("line", "pos")("place"), *[c for c in kept if c not in ("line", "n")])
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(count, F.shiftright("key", 32)).sortWithinPartitions("key").mapInArrow(
        lambda b: _block_pairs(b, percent, every), "id bigint, other bigint, more boolean")
    return found.groupBy("id", "other").agg(F.max("more").alias("more"))


def _cut_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted lines of each document as compressed texts of their own."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        ids, blobs = [], []
        for text, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
            lines = text.as_py().encode().split(b"\n")
            for w in wanted:
                ids.append(w["id"]), blobs.append(squeeze.compress(lines[w["line"]]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["id", "blob"])


def matched(docs: DataFrame, reps: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """id of the classes of `pairs` whose whole lines match those of their `other`."""
    met = pairs.select(F.explode(F.array("id", "other")).alias("id")).distinct()
    # a written table has a known size: Spark only shuffles the texts where many lines are wanted
    wanted = materialize(reps.select("id", "doc_id", "body", "line").join(met, "id").groupBy("doc_id", "body").agg(
        F.collect_list(F.struct("id", "line")).alias("wanted")), "line-wanted")
    same = F.col("w.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("w.body") == F.col("d.body"))
    read = with_body(docs).select("doc_id", "body", "text")
    texts = read.alias("d").join(wanted.alias("w"), same).select("d.text", "w.wanted").mapInArrow(_cut_lines, "id bigint, blob binary")
    once = texts.groupBy("id").agg(F.first("blob").alias("blob"))  # a repeated document gives its lines again
    good = sj.jaccard_of_texts(pairs.select(F.col("id").alias("a"), F.col("other").alias("b")), once, lambda w: token_sets(w)[0], percent)
    return good.select(F.col("a").alias("id")).distinct()


def kept_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, body (hash of the text), kept: numbers of the lines with words that no earlier line matches."""
    reps = materialize(line_classes(docs, percent, word_counts(docs)), "line-classes")
    hot = reps.select(F.explode("tail").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > TILE)
    hot = materialize(hot.select("token", F.ceil(F.col("held") / TILE).cast("int").alias("parts")), "line-hot")
    with larger_batches(docs.sparkSession):  # rows of some numbers each
        pairs = materialize(candidates(reps, hot, percent), "line-pairs")
    gone = materialize(matched(docs, reps, pairs, percent), "line-found")
    undecided = materialize(pairs.filter("more").select("id").distinct().join(gone, "id", "left_anti"), "line-open")
    if not undecided.isEmpty():
        rest = candidates(reps, hot, percent, undecided).join(pairs, ["id", "other"], "left_anti")
        gone = gone.union(matched(docs, reps, materialize(rest, "line-pairs"), percent))
    left = reps.select("id", "doc_id", "body", "line").join(gone, "id", "left_anti")
    return left.groupBy("doc_id", "body").agg(F.collect_set("line").alias("kept"))


def _of_lines(make: Callable[[Column], Column]) -> Column:
    """make(lines of the text); as an argument of a lambda the lines are cut once, however often they are used."""
    return F.transform(F.array(F.split("text", "\n")), make)[0]


def _worded(lines: Column) -> Column:
    """Numbers of the lines with words."""
    return F.array_compact(F.transform(lines, lambda line, i: F.when(line.rlike(r"[^\x20\x09-\x0D]"), i)))


def _without_kept(texts: DataFrame, kept: DataFrame) -> DataFrame:
    """`texts` (doc_id, body, worded, ...) with the column `removed`: worded lines that `kept` does not name."""
    kept = kept.withColumnsRenamed({"doc_id": "d", "body": "b"})
    out = texts.join(kept, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("b") == F.col("body")), "left")
    return out.withColumn("removed", F.array_except("worded", F.coalesce("kept", F.array().cast("array<int>"))))


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, body (hash of the text), removed (sorted numbers of the lines to drop, from 0).

    Documents without such lines give no row. Rows equal in doc_id and text are one document, whose
    lines do not match themselves. Null doc_ids come first; lines of one number in different texts of a
    doc_id are ordered by their hashes. Lines of any length take part whole. Null and empty texts, lines
    without words and other columns play no part; an empty table gives no rows.
    """
    texts = with_body(docs).select("doc_id", "body", _of_lines(_worded).alias("worded")).filter(F.size("worded") > 0).distinct()
    return _without_kept(texts, kept_lines(docs, percent)).select("doc_id", "body", "removed").filter(F.size("removed") > 0)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed for every row of `docs` (an empty text is one line)."""
    both = _of_lines(lambda lines: F.struct(F.size(lines).cast("long").alias("n_lines"), _worded(lines).alias("worded")))
    base = with_body(docs).select("doc_id", "body", both.alias("of")).select("doc_id", "body", "of.*")
    return _without_kept(base, kept_lines(docs)).select(
        "doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def without_lines(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """`docs`, all its columns, with the lines of `gone` (see removed_lines) cut from `text`."""
    names = docs.columns
    gone = gone.select(F.col("doc_id").alias("__d"), F.col("body").alias("__b"), F.col("removed").alias("__gone"))
    joined = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__b")), "left")
    kept = _of_lines(lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__gone"), lambda i: F.get(lines, i)), "\n"))
    return joined.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)).select(*names)
