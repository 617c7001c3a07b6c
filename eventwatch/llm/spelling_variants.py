"""Spelling variants by a frequency-vector trie (operator 13).

A word's vector counts its letters by group: the commonest letters have a group each, the others share.
Words are arranged in a trie by successive counts. One inserted letter is a surplus of one in some group, a
deleted one a deficit of one, a replaced one both or neither; so a search walks the trie depth first with a
budget of one surplus and one deficit, and words at the leaves it reaches are verified letter by letter.

The first levels cut the trie into subtries, which are what Spark shuffles by. A word goes into its own subtrie
and, as a query, into those its budget can reach; of the two directions of a pair only the one whose first
difference is a surplus is followed. A subtrie with many words is held in chunks, so no task holds more than
about `CHUNK` words, and queries stream past them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eventwatch.llm.text_arrays import utf8, within
from eventwatch.session import materialize

#: A run of at least this many letters; fewer can never give a word.
MIN_LENGTH, MIN_COUNT = 7, 2
RUN = f"[A-Za-zÀ-ÿ]{{{MIN_LENGTH},}}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in MANGLED, chosen by its checksum, loses a letter.
MANGLED = 31
#: A form stands at least this many times more often than its variant.
FACTOR = 10
#: Groups of the commonest letters, one each, and groups the others share.
OWN, SHARED = 20, 4
GROUPS = OWN + SHARED
#: Words expected in a subtrie, and held by a task at most (about).
SUBTRIE, CHUNK = 16_384, 65_536
#: Counts above this are taken as this, which can only make two words look nearer.
MOST = 31
#: Words up to this length are verified side by side, longer ones one by one.
WIDTH = 32
#: A node with this many words is a leaf.
LEAF = 2
QUERIES, PAIRS = 8_192, 1 << 20


def words_of(docs: DataFrame) -> DataFrame:
    """word, n: the distinct words and how often they stand in all texts, from MIN_COUNT on."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    low = runs.select("id", F.translate("run", UPPER, LOWER).alias("word"))
    crc = low.withColumn("crc", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")))
    at = (F.col("crc") % F.length("word")).cast("int")
    cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
    word = F.when(F.col("crc") % MANGLED == 0, cut).otherwise(F.col("word"))
    return crc.select(word.alias("word")).filter(F.length("word") >= MIN_LENGTH).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_COUNT)


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of words whose letters all lie below 256: two UTF-8 bytes at most each."""
    data, at = utf8(column)
    lead = data >= 0xC0
    codes = data.copy()
    codes[1:][lead[:-1]] += (data[:-1][lead[:-1]] & 1) * np.uint8(0x40)
    before = np.r_[0, np.cumsum(lead)]
    return codes[~lead], at - before[at]


def letter_groups(words: DataFrame) -> np.ndarray:
    """Group of each of the 256 code points, by how often the vocabulary uses them."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            total += np.bincount(letters(batch.column(0))[0], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], ["code", "n"])

    seen = np.zeros(256, np.int64)
    for r in words.select("word").mapInArrow(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect():
        seen[r.code] = r.n
    rank = np.empty(256, np.int64)
    rank[np.lexsort((np.arange(256), -seen))] = np.arange(256)
    return np.where(rank < OWN, rank, OWN + (rank - OWN) % SHARED)


def vectors(codes: np.ndarray, at: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Counts by group, up to MOST."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return np.minimum(np.bincount(row * GROUPS + groups[codes], minlength=(len(at) - 1) * GROUPS), MOST).reshape(-1, GROUPS).astype(np.int16)


def steps(levels: int) -> list[tuple[np.ndarray, int, int]]:
    """(change of the first counts, surplus left, deficit left) of one direction of every pair."""
    out = [(np.zeros(levels, np.int16), 1, 1)]
    for i in range(levels):
        more = np.zeros(levels, np.int16)
        more[i] = 1
        out.append((more, 0, 1))
        for j in range(i + 1, levels):
            both = more.copy()
            both[j] = -1
            out.append((both, 0, 0))
    return out


def subtrie(counts: np.ndarray) -> np.ndarray:
    key = np.zeros(len(counts), np.int64)
    for c in counts.T:
        key = key * (MOST + 1) + c
    return key


ROUTED = "subtrie bigint, surplus int, deficit int, word string, n bigint"


def routed(words: DataFrame, groups: np.ndarray, levels: int, queries: bool) -> DataFrame:
    """Every word in its own subtrie, or as a query in all it can reach, with the budget that is left."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top = vectors(*letters(batch.column(0)), groups)[:, :levels]
            for change, more, less in steps(levels) if queries else steps(0):
                there = top + change if queries else top
                at = np.flatnonzero(((there >= 0) & (there <= MOST)).all(axis=1))
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(subtrie(there[at])), pa.array(np.full(len(at), more, np.int32)), pa.array(np.full(len(at), less, np.int32)),
                     *part.columns], ["subtrie", "surplus", "deficit", "word", "n"])

    return words.mapInArrow(run, ROUTED)


class Trie:
    """Words of one chunk, sorted by their vectors from `level` on; a node is a range of them."""

    def __init__(self, column: pa.Array, n: np.ndarray, groups: np.ndarray, level: int):
        codes, at = letters(column)
        v = vectors(codes, at, groups)[:, level:]
        order = np.lexsort(v.T[::-1]) if v.shape[1] else np.arange(len(v))
        self.column, self.n = column.take(pa.array(order)), n[order]
        self.text = Text(*letters(self.column))
        v = v[order]
        # by level: the nodes' first words, and each node's child for every count (-1: none)
        self.starts, self.child = [np.zeros(1, np.int64)], []
        node = np.zeros(len(v), np.int64)
        for c in range(v.shape[1]):
            width = int(v[:, c].max()) + 1
            both = node * width + v[:, c]
            fresh = np.flatnonzero(np.r_[True, np.diff(both) != 0])
            table = np.full((len(self.starts[-1]), width), -1, np.int32)
            table[node[fresh], v[fresh, c]] = np.arange(len(fresh))
            self.child.append(table)
            self.starts.append(fresh)
            node = np.repeat(np.arange(len(fresh)), np.diff(np.r_[fresh, len(v)]))

    def reach(self, v: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, first word, end) for all leaves that the queries' budgets reach."""
        size = len(self.n)
        q, node, more, less = np.arange(len(v)), np.zeros(len(v), np.int64), surplus.copy(), deficit.copy()
        found = []
        for c, table in enumerate(self.child):
            first, end = self.starts[c][node], np.r_[self.starts[c], size][node + 1]
            few = end - first <= LEAF
            found.append((q[few], first[few], end[few]))
            q, node, more, less = q[~few], node[~few], more[~few], less[~few]
            if not len(q):
                break
            own, parts = v[q, c].astype(np.int64), []
            for change in (0, 1, -1):
                want = own + change
                may = np.flatnonzero((more > 0 if change > 0 else less > 0 if change < 0 else True) & (want >= 0) & (want < table.shape[1]))
                below = table[node[may], want[may]]
                there = below >= 0
                may, below = may[there], below[there].astype(np.int64)
                parts.append((q[may], below, more[may] - (change > 0), less[may] - (change < 0)))
            q, node, more, less = (np.concatenate(x) for x in zip(*parts))
        else:
            found.append((q, self.starts[-1][node], np.r_[self.starts[-1], size][node + 1]))
        return tuple(np.concatenate(x) for x in zip(*found))


class Text:
    """Letters of words, padded on the right and on the left; words over WIDTH letters are kept as bytes."""

    def __init__(self, codes: np.ndarray, at: np.ndarray):
        self.size = np.diff(at)
        self.codes, self.at = codes, at
        cut = np.minimum(self.size, WIDTH)
        row, k = np.repeat(np.arange(len(cut)), cut), within(cut)
        self.left = np.zeros((len(cut), WIDTH), np.uint8)
        self.left[row, k] = codes[at[:-1][row] + k]
        self.right = np.zeros((len(cut), WIDTH), np.uint8)
        self.right[row, WIDTH - 1 - k] = codes[at[1:][row] - 1 - k]
        # words differing by one letter share their first or their last three
        self.head = np.ascontiguousarray(self.left[:, :4]).view(np.uint32)[:, 0] & np.uint32(0xFFFFFF)
        self.tail = np.ascontiguousarray(self.right[:, -4:]).view(np.uint32)[:, 0] >> np.uint32(8)

    def word(self, i: int) -> bytes:
        return self.codes[self.at[i]:self.at[i + 1]].tobytes()


def is_near(a: bytes, b: bytes) -> bool:
    """Exactly one letter inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short = min(len(a), len(b))
    p = next((i for i in range(short) if a[i] != b[i]), short)
    return a[p + 1:] == b[p + 1:] if len(a) == len(b) else (a[p:] == b[p + 1:] if len(a) < len(b) else a[p + 1:] == b[p:])


def verified(x: Text, i: np.ndarray, y: Text, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(near, first before second in code-point order) of pairs of words."""
    near, before = np.zeros(len(i), bool), np.zeros(len(i), bool)
    close = (x.head[i] == y.head[j]) | (x.tail[i] == y.tail[j])
    a, b = x.size[i], y.size[j]
    close &= np.abs(a - b) <= 1
    short = np.flatnonzero(close & (a <= WIDTH) & (b <= WIDTH))
    left, other = x.left[i[short]], y.left[j[short]]
    differs = left != other
    p = np.where(differs.any(axis=1), differs.argmax(axis=1), WIDTH)
    apart = x.right[i[short]] != y.right[j[short]]
    s = np.where(apart.any(axis=1), apart[:, ::-1].argmax(axis=1), WIDTH)
    least = np.minimum(a[short], b[short])
    p, s, same = np.minimum(p, least), np.minimum(s, least), a[short] == b[short]
    near[short] = np.where(same, p + s == least - 1, p + s >= least)
    k, rows = np.minimum(p, WIDTH - 1), np.arange(len(short))
    before[short] = np.where(p >= WIDTH, a[short] < b[short], left[rows, k] < other[rows, k])
    for t in np.flatnonzero(close & ((a > WIDTH) | (b > WIDTH))):
        u, w = x.word(i[t]), y.word(j[t])
        near[t], before[t] = is_near(u, w), u < w
    return near, before


class Best:
    """Near words so far of each word of a block: how many, and the one of largest n, then smallest."""

    def __init__(self, size: int):
        self.count, self.n, self.word = np.zeros(size, np.int64), np.zeros(size, np.int64), np.full(size, None, object)

    def add(self, at: np.ndarray, n: np.ndarray, words: np.ndarray) -> None:
        if not len(at):
            return
        self.count += np.bincount(at, minlength=len(self.count))
        top = self.n.copy()
        np.maximum.at(top, at, n)
        tops = np.flatnonzero(n == top[at])
        for k, w in zip(at[tops].tolist(), words[tops].tolist()):
            if top[k] > self.n[k] or self.word[k] is None or w < self.word[k]:
                self.n[k], self.word[k] = top[k], w

    def rows(self, column: pa.Array) -> pa.RecordBatch:
        at = np.flatnonzero(self.count)
        return pa.RecordBatch.from_arrays(
            [column.take(pa.array(at)), pa.array(self.count[at]), pa.array(self.n[at]), pa.array(self.word[at].tolist(), pa.string())],
            ["word", "near", "top", "form"])


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, top, form: how many near words a word of `words` (word, n) has, and the best of them."""
    total = words.count()
    levels = int(np.clip(math.ceil(math.log(max(total, 1) / SUBTRIE, 4)), 1, 7))
    groups = letter_groups(words)
    own = routed(words, groups, levels, False)
    sizes = materialize(own.groupBy("subtrie").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")), "subtries")
    held = own.join(sizes, "subtrie").select("subtrie", F.pmod(F.xxhash64("word"), "chunks").cast("int").alias("chunk"), F.lit(0).alias("query"),
                                             "surplus", "deficit", "word", "n")
    # subtries nobody lives in get no queries
    asked = routed(words, groups, levels, True).join(sizes, "subtrie").select(
        "subtrie", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("query"), "surplus", "deficit", "word", "n")
    met = held.unionByName(asked).repartition("subtrie", "chunk").sortWithinPartitions("subtrie", "chunk", "query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, trie, best, strings = None, [], None, None, None
        for batch in batches:
            key, chunk, query = (batch.column(c).to_numpy() for c in range(3))
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(chunk) != 0) | (np.diff(query) != 0)) + 1
            for i, j in zip(np.r_[0, cuts], np.r_[cuts, len(key)]):
                if now != (key[i], chunk[i]):
                    if best:
                        yield best.rows(trie.column)
                    now, parts, trie, best = (key[i], chunk[i]), [], None, None
                part = batch.slice(i, j - i)
                if not query[i]:
                    parts.append((part.column(5), part.column(6).to_numpy()))
                    continue
                if trie is None:
                    trie = Trie(pa.concat_arrays([p for p, _ in parts]), np.concatenate([n for _, n in parts]), groups, levels)
                    best, strings = Best(len(trie.n)), np.array(trie.column.to_pylist(), object)
                for k in range(0, j - i, QUERIES):
                    yield from meet(part.slice(k, QUERIES), trie, best, strings)
        if best:
            yield best.rows(trie.column)

    def meet(part: pa.RecordBatch, trie: Trie, best: Best, strings: np.ndarray) -> Iterator[pa.RecordBatch]:
        column, n = part.column(5), part.column(6).to_numpy()
        codes, at = letters(column)
        text, names, mine = Text(codes, at), np.array(column.to_pylist(), object), Best(len(n))
        more, less = part.column(3).to_numpy(), part.column(4).to_numpy()
        q, first, end = trie.reach(vectors(codes, at, groups)[:, levels:], more, less)
        cuts = np.flatnonzero(np.diff(np.cumsum(end - first) // PAIRS)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(q)]):
            sizes = end[a:b] - first[a:b]
            i, j = np.repeat(q[a:b], sizes), np.repeat(first[a:b], sizes) + within(sizes)
            near, before = verified(text, i, trie.text, j)
            # words of one subtrie meet in both directions
            near &= before | (more[i] + less[i] < 2)
            i, j = i[near], j[near]
            mine.add(i, trie.n[j], strings[j])
            best.add(j, n[i], names[i])
        yield mine.rows(column)

    found = met.mapInArrow(run, "word string, near bigint, top bigint, form string")
    best = F.min(F.struct((-F.col("top")).alias("n"), F.col("form")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.n")).alias("top"), "b.form")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of `forms` (word, form): each round doubles the links followed; counts grow by FACTOR a link, so chains are short."""
    links = materialize(forms.select("word", F.col("form").alias("root")), "links")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if links.join(ahead, "root", "left_semi").isEmpty():
            return links
        links = materialize(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "links")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of `docs` (doc_id, text).

    Words are maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case, one in MANGLED
    short of a letter by its checksum. Null and empty texts have none; a null id counts as empty text in the
    checksum; repeated rows count again; ties in n go to the smaller word; very long words are compared
    one by one; other columns are ignored; an empty table gives no rows.
    """
    words = materialize(words_of(docs), "words")
    near = near_words(words)
    n = words.join(near, "word", "left").withColumn("known", F.coalesce(F.col("top") >= FACTOR * F.col("n"), F.lit(False)))
    rows = materialize(n.select("word", F.when(F.col("known"), F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                F.when(F.col("known"), F.col("top")).alias("form_n")), "variants")
    ends = roots(rows.filter(F.col("form").isNotNull()))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
