"""Language identification by sparse multinomial logistic regression (operator 6).

Features are TF-IDF weights of character 1-, 2- and 3-grams, hashed into `BUCKETS` and scaled to unit
length. Document frequencies are counted over all training documents. The weights are learned by
follow-the-regularised-leader with L1 and L2 penalties on a sample of at most `MAX_SAMPLE` training
documents (the ids with the smallest hash, whole texts), and a temperature is fitted on the part of
the sample kept out of learning. The model has a fixed size.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eventwatch.llm.text_arrays import crc_of_id, id_and_text, lists, mix, slices
from eventwatch.session import materialize

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
MAX_SAMPLE = 3_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
#: Rows whose dense count table is held at a time.
ROWS = 512
UNKNOWN = "und"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(code in lower case with all but letters as space, is letter) for the basic plane."""
    low, letter = np.full(65536, 32, np.uint32), np.zeros(65536, bool)
    for c in range(65536):
        if unicodedata.category(chr(c))[0] in "LM":
            s = chr(c).lower()
            low[c], letter[c] = ord(s[0]), unicodedata.category(chr(c))[0] == "L"
    return low, letter


_LOW, _LETTER = None, None


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case code points, row of each, letters per row); a space parts the rows."""
    global _LOW, _LETTER
    if _LOW is None:
        _LOW, _LETTER = _tables()
    codes = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    basic = np.minimum(codes, 65535)
    high = codes > 65535
    low, letter = _LOW[basic], _LETTER[basic]
    if high.any():
        # beyond the basic plane a code point is its own lower case
        is_letter = {c: unicodedata.category(chr(c))[0] == "L" for c in np.unique(codes[high]).tolist()}
        letter[high] = [is_letter[c] for c in codes[high].tolist()]
        low[high] = np.where(letter[high], codes[high], 32)
    return low, row, np.bincount(row, weights=letter, minlength=len(texts)).astype(np.int64)


def features(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row, bucket, count of each used bucket, letters per row) for blocks of rows."""
    for first in range(0, len(texts), ROWS):
        part = texts[first:first + ROWS]
        code, row, letters = code_points(part)
        table = np.zeros(len(part) * BUCKETS, np.int32)
        key = np.zeros(len(code), np.uint64)
        for n in ORDERS:
            k = len(code) - n + 1
            key = key[:k] * np.uint64(0x100000001B3) + code[n - 1:].astype(np.uint64) + np.uint64(n)
            # grams of blanks only and grams across rows say nothing
            use = (row[:k] == row[n - 1:]) & ~((code[:k] == 32) & (code[n - 1:] == 32))
            spot = row[:k][use] * BUCKETS + (mix(key[use]) >> np.uint64(50)).astype(np.int64)
            table += np.bincount(spot, minlength=len(table)).astype(np.int32)
        used = np.flatnonzero(table)
        yield first, used // BUCKETS, used % BUCKETS, table[used], letters


def weigh(row: np.ndarray, bucket: np.ndarray, count: np.ndarray, idf: np.ndarray, rows: int) -> np.ndarray:
    value = (1 + np.log(count)) * idf[bucket]
    norm = np.sqrt(np.bincount(row, weights=value * value, minlength=rows))
    return value / norm[row]


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS, languages)
    idf: np.ndarray
    temperature: float = 1.0

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        for first, row, bucket, count, letters in features(texts):
            rows = len(letters)
            if self.languages:
                value = weigh(row, bucket, count, self.idf, rows)
                z = np.stack([np.bincount(row, weights=value * self.weights[bucket, k], minlength=rows)
                              for k in range(len(self.languages))], axis=1)
                p = softmax(z / self.temperature)
                top = p.argmax(axis=1)
            for r in range(rows):
                known = bool(letters[r]) and bool(self.languages)
                names.append(self.languages[top[r]] if known else UNKNOWN)
                scores[first + r] = p[r, top[r]] if known else 0.0
        return names, scores


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def learn(buckets: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, languages: int) -> np.ndarray:
    """FTRL-proximal: per-coordinate rates, weights exactly zero below the L1 level."""
    z, n = np.zeros((BUCKETS, languages)), np.zeros((BUCKETS, languages))

    def weights(at) -> np.ndarray:
        return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(y)):
            b, v = buckets[i], values[i]
            w = weights(b)
            p = softmax((v @ w)[None, :])[0]
            p[y[i]] -= 1
            g = v[:, None] * p[None, :]
            sigma = (np.sqrt(n[b] + g * g) - np.sqrt(n[b])) / ALPHA
            z[b] += g - sigma * w
            n[b] += g * g
    return weights(slice(None))


def calibrate(z: np.ndarray, y: np.ndarray) -> float:
    """Temperature with the least log-loss on rows that learning did not see."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.1), np.log(10), 200))
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, limit: int = MAX_SAMPLE) -> LanguageModel:
    """Learn from text and lang of the rows whose crc32(doc_id) mod 3 is not 1 and lang is not null."""
    base = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (crc_of_id() % 3 != 1))
    small = id_and_text(base)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for i, j, _, _ in slices(batch.column(1)):
                for _, _, bucket, _, letters in features(batch.column(1).slice(i, j - i).to_pylist()):
                    total += np.bincount(bucket, minlength=BUCKETS)
                    rows += len(letters)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[used, -1]), pa.array(np.r_[total[used], rows])], ["bucket", "n"])

    counted = small.mapInArrow(frequencies, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(BUCKETS)
    inner = counted[counted.bucket >= 0]
    seen[inner.bucket.to_numpy()] = inner.n.to_numpy()
    rows = float(counted[counted.bucket < 0].n.sum())
    idf = np.log((1 + rows) / (1 + seen)) + 1
    # only ids are sorted; at most `limit` of them are broadcast
    chosen = base.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    sample = base.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                         F.col("lang").cast("string").alias("lang")).join(F.broadcast(chosen), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, _ in slices(batch.column(1)):
                for first, row, bucket, count, letters in features(batch.column(1).slice(i, j - i).to_pylist()):
                    value = weigh(row, bucket, count, idf, len(letters))
                    sizes = np.bincount(row, minlength=len(letters))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(i + first, len(letters)), batch.column(2).slice(i + first, len(letters)),
                         lists(bucket.astype(np.int32), sizes), lists(value.astype(np.float32), sizes), pa.array(letters)],
                        ["doc_id", "lang", "buckets", "weights", "letters"])

    got = materialize(sample.mapInArrow(
        extract, "doc_id bigint, lang string, buckets array<int>, weights array<float>, letters bigint"), "language-sample")
    table = got.filter("letters > 0").limit(2 * limit).toArrow()
    order = sorted(range(table.num_rows), key=lambda i: (table["doc_id"][i].as_py(), table["lang"][i].as_py()))
    languages = sorted(set(table["lang"].to_pylist()))
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), idf)
    buckets = [table["buckets"][i].values.to_numpy() for i in order]
    values = [table["weights"][i].values.to_numpy().astype(np.float64) for i in order]
    y = np.array([languages.index(table["lang"][i].as_py()) for i in order])
    kept_out = np.arange(len(y)) % 5 == 0 if len(y) >= 50 else np.zeros(len(y), bool)
    inside = np.flatnonzero(~kept_out)
    weights = learn([buckets[i] for i in inside], [values[i] for i in inside], y[inside], len(languages))
    z = np.array([values[i] @ weights[buckets[i]] for i in np.flatnonzero(kept_out)]).reshape(-1, len(languages))
    return LanguageModel(languages, weights, idf, calibrate(z, y[kept_out]))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score for every row of `docs`.

    Texts that are null or have no letters get `und` with score 0, as all do when nothing was learned.
    Repeated rows give repeated results; other columns are ignored; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, _ in slices(batch.column(1)):
                names, scores = model.predict(batch.column(1).slice(i, j - i).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id bigint, lang_pred string, score double")
