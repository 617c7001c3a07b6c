"""Quality classifier: logistic regression on hashed word n-grams (operator 11).

A document is two streams of tokens: its words (ASCII letters in lower case, punctuation at both ends
cut off) and the shapes of its words (case pattern, kind and number of symbols at the end, whether the word
repeats the one before it). Word 1- and 2-grams and shape 1- to 3-grams are hashed into `BUCKETS`; each
stream weighs 1 + ln(count) and is scaled to unit length. Weights are learned by
follow-the-regularised-leader updates, one document at a time, from a sample of at most `MAX_LABELLED`
labelled documents (the ids with the smallest hash, whole texts). Only non-zero weights travel to the
tasks; a score is the sparse dot product of a text's buckets with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eventwatch.llm.text_arrays import Words, crc_of_id, id_and_text, lists, lower, mix, range_hashes, slices
from eventwatch.session import materialize

BUCKETS = 1 << 18
WORD_ORDERS, SHAPE_ORDERS = 2, 3
MAX_LABELLED = 4_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.2, 1.0, 0.01, 0.02
THRESHOLD = 0.3

_CODES = np.arange(256)
_UPPER = (_CODES >= 65) & (_CODES <= 90)
_DIGIT = (_CODES >= 48) & (_CODES <= 57)
_LETTER = _UPPER | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)
_PLAIN = _LETTER | _DIGIT


def _count(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(mask)]
    return total[end] - total[start]


def tokens(words: Words, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the trimmed word, shape) of each word; a word without letter or digit is kept whole."""
    start, end, plain = words.start, words.end, _PLAIN[data]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    at = np.flatnonzero(plain)
    first = np.r_[at, len(data)][np.searchsorted(at, start)]
    last = np.r_[0, at + 1][np.searchsorted(at, end)]
    bare = first >= end
    first, last = np.where(bare, start, first), np.where(bare, end, last)
    core = range_hashes(lower(data), first, last)
    letters, upper = _count(_LETTER[data], start, end), _count(_UPPER[data], start, end)
    case = np.select([letters == 0, upper == 0, (upper == 1) & _UPPER[data[first]], upper == letters], [0, 1, 2, 3], 4)
    tail = np.where(bare, 0, np.minimum(end - last, 3))
    symbol = np.where(bare | (tail > 0), data[end - 1], 0)
    digits = np.minimum(_count(_DIGIT[data], start, end), 1)
    row = words.row
    again = np.r_[False, (core[1:] == core[:-1]) & (row[1:] == row[:-1])]
    shape = (((case * 4 + tail) * 256 + symbol) * 2 + digits) * 2 + again
    return core, mix(shape.astype(np.uint64) + np.uint64(1))


def _grams(hashes: np.ndarray, row: np.ndarray, orders: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram that stays in one row."""
    key, rows, buckets = np.full(len(hashes), seed, np.uint64), [], []
    for n in range(1, orders + 1):
        k = len(hashes) - n + 1
        if k <= 0:
            break
        key = mix(key[:k] * np.uint64(3) + hashes[n - 1:])
        inside = row[:k] == row[n - 1:]
        rows.append(row[:k][inside])
        buckets.append((key[inside] >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(buckets)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight) of the rows' n-grams, in row order."""
    words = Words(data, offsets)
    core, shape = tokens(words, data)
    row, parts = words.row, []
    for hashes, orders, seed in ((core, WORD_ORDERS, 1), (shape, SHAPE_ORDERS, 2)):
        r, b = _grams(hashes, row, orders, seed)
        spot, count = np.unique(r * BUCKETS + b, return_counts=True)
        r, value = spot // BUCKETS, 1 + np.log(count)
        norm = np.sqrt(np.bincount(r, weights=value * value, minlength=len(offsets) - 1))
        parts.append((r, spot % BUCKETS, value / norm[r]))
    r, b, v = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(r, kind="stable")
    return r[order], b[order], v[order]


@dataclass
class QualityModel:
    """`buckets` and `weights` are the non-zero coordinates."""

    bias: float = 0.0
    buckets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def scores(self, data: np.ndarray, offsets: np.ndarray, dense: np.ndarray) -> np.ndarray:
        row, bucket, value = features(data, offsets)
        z = self.bias + np.bincount(row, weights=value * dense[bucket], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))

    def dense(self) -> np.ndarray:
        out = np.zeros(BUCKETS)
        out[self.buckets] = self.weights
        return out


def learn(buckets: list[np.ndarray], values: list[np.ndarray], y: np.ndarray) -> QualityModel:
    """FTRL-proximal, a document at a time: per-coordinate rates, zero below the L1 level; the bias has no penalty."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    l1 = np.full(BUCKETS + 1, L1)
    l1[BUCKETS] = 0.0

    def weights(at) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1[at], 0.0, -(z[at] - np.sign(z[at]) * l1[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    inputs = [(np.r_[b, BUCKETS], np.r_[v, 1.0]) for b, v in zip(buckets, values)]
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(y)):
            b, v = inputs[i]
            w = weights(b)
            g = v * (1 / (1 + np.exp(-np.clip(v @ w, -35, 35))) - y[i])
            sigma = (np.sqrt(n[b] + g * g) - np.sqrt(n[b])) / ALPHA
            z[b] += g - sigma * w
            n[b] += g * g
    w = weights(slice(None))
    used = np.flatnonzero(w[:BUCKETS])
    return QualityModel(float(w[BUCKETS]), used, w[used])


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, quality, text) of at most `limit` labelled documents outside the held-out fifth.

    The ids with the smallest hash are taken; a null label is none, labels that disagree count as the
    larger, and of rows that share an id the smallest text is taken. Only ids and labels are sorted; at
    most `limit` of them are broadcast.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(crc_of_id() % 5 != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    here = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    chosen = known.join(here, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return id_and_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> QualityModel:
    """Learn from documents whose crc32(doc_id) mod 5 is not 0.

    Without labels every score is 0.5; with one class only, that class gets odds of 55 to 1.
    """
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(2)):
                row, bucket, value = features(data, offsets)
                sizes = np.bincount(row, minlength=j - i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), lists(bucket.astype(np.int32), sizes),
                     lists(value.astype(np.float32), sizes)], ["doc_id", "quality", "buckets", "weights"])

    sample = labelled_sample(docs, labels, limit)
    rows = materialize(sample.mapInArrow(
        extract, "doc_id bigint, quality int, buckets array<int>, weights array<float>"), "quality-sample").toArrow()
    rows = rows.sort_by("doc_id").combine_chunks()
    y = (rows["quality"].to_numpy() > 0).astype(float)
    if not len(y) or y.min() == y.max():
        return QualityModel(0.0 if not len(y) else 8.0 * y[0] - 4.0)

    def column(name: str, kind) -> list[np.ndarray]:
        whole = rows[name].combine_chunks()
        at = whole.offsets.to_numpy()
        flat = whole.values.to_numpy().astype(kind)
        return [flat[a:b] for a, b in zip(at[:-1], at[1:])]

    return learn(column("buckets", np.int64), column("weights", np.float64), y)


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1, higher for better texts), predicted (1 from `threshold` on) of every row.

    Null texts, empty ones and those without words have no n-grams and get the score of the bias alone.
    Repeated rows and null ids give a row each with the same score for the same text; very long texts are
    read whole, one at a time; other columns are ignored; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.dense()
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1)):
                p = model.scores(data, offsets, dense)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                    ["doc_id", "score", "predicted"])

    return id_and_text(docs).mapInArrow(run, "doc_id bigint, score double, predicted int")
