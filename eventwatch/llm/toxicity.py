"""Toxicity by maximum-scoring segments (operator 8).

Training counts the toxic and the clean documents with a word, per hash bucket, and turns them into log-odds with
an informative Dirichlet prior. Scoring finds every maximal scoring segment of a document in one
linear scan, rates each by the extreme-value law of such segments (E-value K·n·exp(-λS)), and a
logistic calibration maps the best and the summed evidence to a probability.

Model size is fixed (`BUCKETS` weights and a few numbers). The labels used for fitting are a sample
of at most `MAX_LABELLED` rows, chosen by a hash of the id; whole texts are read in training and
scoring alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eventwatch.llm.text_arrays import NOT_LETTERS, Words, crc_of_id, id_and_text, lower, mix, range_hashes, slices, small_batches

BUCKETS = 1 << 18
MAX_LABELLED = 20_000
PRIOR_SHARE = 0.05  # weight of the Dirichlet prior against all counts, spread by each bucket's share of them
Z_LEVEL = 4.0
EFFECT = 2.5  # log-odds below this are topic or language, not toxicity
BACKGROUND = -0.05
PREFIX_BYTES = (6, 5, 4)
FLOOR, CEILING = -1.0, 12.0
E_LEVEL = 0.05
THRESHOLD = 0.3

SEGMENTS = "array<struct<start:int,end:int,score:double,e_value:double>>"


@dataclass
class ToxicityModel:
    weights: np.ndarray = field(default_factory=lambda: np.full(BUCKETS, BACKGROUND, np.float32))
    rate: float = 1.0   # λ
    scale: float = 1.0  # K
    calibration: tuple[float, float, float, float] = (-4.0, 0.0, 0.0, 0.0)


def buckets(words: Words, data: np.ndarray) -> np.ndarray:
    """(1 + prefixes, n words) buckets: the whole word, then its beginnings from long to short.

    Beginnings catch inflected and compounded forms of a stem that training never saw whole. A word
    no longer than a prefix repeats its whole form there.
    """
    keys = [words.hash]
    lowered = lower(data)
    for size in PREFIX_BYTES:
        longer = words.end - words.start > size
        key = words.hash.copy()
        key[longer] = mix(range_hashes(lowered, words.start[longer], words.start[longer] + size) + np.uint64(size))
        keys.append(key)
    return (np.stack(keys) >> np.uint64(46)).astype(np.int64)


def word_scores(words: Words, data: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per word the score of its longest form that tells toxic from clean, else the background."""
    out = np.full(len(words.hash), BACKGROUND)
    for row in buckets(words, data)[::-1]:
        w = weights[row]
        out = np.where(w != np.float32(BACKGROUND), w, out)
    return out


def log_odds(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Score per bucket: log-odds where they differ significantly, else the slightly negative background."""
    both = toxic + clean
    prior = (both + 0.01) * PRIOR_SHARE
    t, c = toxic + prior, clean + prior
    n_t, n_c = t.sum(), c.sum()
    delta = np.log(t / (n_t - t)) - np.log(c / (n_c - c))
    z = delta / np.sqrt(1 / t + 1 / c)
    telling = (np.abs(z) >= Z_LEVEL) & ((delta < 0) | (delta >= EFFECT))
    return np.where(telling, np.clip(delta, FLOOR, CEILING), BACKGROUND).astype(np.float32)


def decay_rate(weights: np.ndarray, clean: np.ndarray) -> float:
    """λ > 0 with Σ p·exp(λ·s) = 1 over clean documents' words."""
    p = clean + 0.5 / len(clean)
    p = p / p.sum()
    if not (weights > 0).any() or float(p @ weights) >= 0:
        return 1.0
    low, high = 1e-6, 50.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if float(p @ np.exp(mid * weights.astype(float))) < 1 else (low, mid)
    return low


def maximal_segments(at: np.ndarray, gain: np.ndarray, before: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, as (first word, end word, score), in one pass.

    `at` are the places of the positive scores, `gain` the scores, `before` the total of all scores
    ahead of each place. A segment is kept as (total before it, total at its end); a new one either
    stands alone or absorbs the earlier ones it improves on.
    """
    kept: list[list] = []
    for i, g, left in zip(at.tolist(), gain.tolist(), before.tolist()):
        new = [i, i + 1, left, left + g]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j -= 1
            if j < 0 or kept[j][3] >= new[3]:
                kept.append(new)
                break
            new = [kept[j][0], new[1], kept[j][2], new[3]]
            del kept[j:]
    return [(a, b, end - start) for a, b, start, end in kept]


def _features(data: np.ndarray, offsets: np.ndarray, model: ToxicityModel) -> tuple[np.ndarray, list[list[tuple]]]:
    """(n words, best λS, sum of significant λS - ln Kn) per row and the significant segments."""
    words = Words(data, offsets, breaks=NOT_LETTERS)
    score = word_scores(words, data, model.weights)
    total = np.r_[0.0, np.cumsum(score)]
    counts = np.diff(words.first)
    out = np.zeros((len(counts), 3))
    out[:, 0] = counts
    found: list[list[tuple]] = [[] for _ in counts]
    positive = np.flatnonzero(score > 0)
    cut = np.searchsorted(positive, words.first)
    for r in np.flatnonzero(np.diff(cut)):
        p, base = positive[cut[r]:cut[r + 1]], words.first[r]
        segments = maximal_segments(p - base, score[p], total[p] - total[base])
        size = np.log(max(model.scale * counts[r], 1e-300))
        out[r, 1] = max(s for _, _, s in segments) * model.rate
        for a, b, s in segments:
            e_value = float(np.exp(min(size - model.rate * s, 700.0)))
            if e_value < E_LEVEL:
                out[r, 2] += model.rate * s - size
                found[r].append((a, b, s, e_value))
    return out, found


def _inputs(f: np.ndarray) -> np.ndarray:
    return np.c_[np.ones(len(f)), np.log1p(f[:, 1]), np.log1p(f[:, 0]) / 4, np.log1p(f[:, 2]) / 4]


def _probability(f: np.ndarray, calibration) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_inputs(f) @ np.asarray(calibration), -30, 30)))


def _calibrate(f: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression: Newton steps with a small ridge, halved until the loss falls."""
    if not len(y):
        return ToxicityModel().calibration
    x, penalty = _inputs(f), np.array([1e-6, 1.0, 1.0, 1.0])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + (penalty * w * w).sum() / 2)

    w = np.zeros(4)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return tuple(w)


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """(toxic, text) of at most `limit` labelled documents outside the held-out quarter.

    The ids with the smallest hash are taken, one label each (the larger where labels disagree; a
    null label is none). Only ids and labels are sorted; at most `limit` of them are broadcast.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    known = known.filter(crc_of_id() % 4 != 2).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("toxic", "text")


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from documents whose crc32(doc_id) mod 4 is not 2; no labels at all give a constant score."""
    from eventwatch.session import materialize

    sample = materialize(labelled_sample(docs, labels), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            toxic = np.asarray(batch.column(0)) > 0
            for i, j, data, offsets in slices(batch.column(1)):
                words = Words(data, offsets, breaks=NOT_LETTERS)
                # a form counts once a document
                once = np.unique((words.row * BUCKETS + buckets(words, data)).ravel())
                side = toxic[i:j][once // BUCKETS].astype(np.int64)
                sums += np.bincount(side * BUCKETS + once % BUCKETS, minlength=2 * BUCKETS).reshape(2, BUCKETS)
        used = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[1][used]), pa.array(sums[0][used])], ["bucket", "toxic", "clean"])

    rows = sample.mapInArrow(count, "bucket bigint, toxic bigint, clean bigint").groupBy("bucket").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toPandas()
    toxic, clean = np.zeros(BUCKETS), np.zeros(BUCKETS)
    toxic[rows.bucket.to_numpy(np.int64)] = rows.toxic
    clean[rows.bucket.to_numpy(np.int64)] = rows.clean
    if not toxic.sum() or not clean.sum():
        share = float(toxic.sum() > 0)
        return ToxicityModel(calibration=(8.0 * share - 4.0, 0.0, 0.0, 0.0))
    weights = log_odds(toxic, clean)
    model = ToxicityModel(weights, decay_rate(weights, clean))

    def measured(model: ToxicityModel) -> tuple[np.ndarray, np.ndarray]:
        got = sample.mapInArrow(lambda b: _measure(b, model), "toxic int, n double, best double, total double").toPandas()
        return got[["n", "best", "total"]].to_numpy(float), got.toxic.to_numpy(float)

    f, y = measured(model)
    # K by moments from the best segments of clean documents (mean of λS - ln n is ln K + 0.5772)
    base = f[(y == 0) & (f[:, 1] > 0) & (f[:, 0] > 0)]
    if len(base) >= 20:
        model.scale = float(np.clip(np.exp(np.mean(base[:, 1] - np.log(base[:, 0])) - 0.5772), 1e-6, 1.0))
    else:
        model.scale = float(np.clip(clean @ (weights > 0) / clean.sum(), 1e-6, 1.0)) or 1e-6
    f, y = measured(model)
    model.calibration = _calibrate(f, y)
    return model


def _measure(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in slices(batch.column(1)):
            f, _ = _features(data, offsets, model)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), *(pa.array(f[:, k]) for k in range(3))], ["toxic", "n", "best", "total"])


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1), predicted, passages (word spans of every significant toxic passage).

    Null and empty texts have no words and get the calibrated score of no evidence. One row per input
    row; other columns are ignored; an empty table gives no rows. Words are runs of letters, digits,
    apostrophes and non-ASCII characters, ASCII letters in lower case.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1)):
                f, found = _features(data, offsets, model)
                p = _probability(f, model.calibration)
                spans = [[dict(zip(("start", "end", "score", "e_value"), s)) for s in row] for row in found]
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(spans, kind)],
                    ["doc_id", "score", "predicted", "passages"])

    return id_and_text(docs).mapInArrow(run, f"doc_id bigint, score double, predicted int, passages {SEGMENTS}")


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all their columns, that score below the threshold."""
    small_batches(docs.sparkSession)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(place)):
                f, _ = _features(data, offsets, model)
                yield batch.slice(i, j - i).filter(pa.array(_probability(f, model.calibration) < threshold))

    return docs.mapInArrow(run, docs.schema)
