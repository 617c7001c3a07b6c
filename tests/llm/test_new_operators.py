"""Quality classifier, hard negatives and spelling variants against plain Python and held-out labels."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventwatch.llm import hard_negatives, quality_model, spelling_variants

SF = "/root/testdata/sf0.01"
LOW = str.maketrans(spelling_variants.UPPER, spelling_variants.LOWER)


# --- quality classifier -----------------------------------------------------------------------

def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.fit(docs, labels)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = quality_model.score(docs, model).filter(held).join(labels.filter("quality is not null"), "doc_id").collect()
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    above = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert len(rows) > 50 and above > 0.97
    assert sum(r.predicted for r in rows if r.quality) / len(good) > 0.97
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    assert quality_model.score(docs, model).count() == docs.count()


def test_quality_grams_by_hand():
    """Buckets and weights of a text do not depend on its neighbours, and count what is there."""
    texts = ["the cat, the cat!!", "", "UPPER lower Mixed1 ***", "a a a a", "é ß", "\n \t", "x" * 5000 + " y"]

    def one(part):
        raw = [t.encode() for t in part]
        at = np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)
        return quality_model.features(np.frombuffer(b"".join(raw), np.uint8), at)

    row, bucket, value = one(texts)
    for i, t in enumerate(texts):
        _, b, v = one([t])
        assert bucket[row == i].tolist() == b.tolist() and np.allclose(value[row == i], v)
        # both streams have unit length
        assert np.isclose((v ** 2).sum(), 2 if t.split() else 0)
    # 2 words and 2 pairs; 3 shapes (plain, with a comma, with two marks), 3 pairs and 2 triples of shapes
    assert len(one([texts[0]])[1]) == 2 + 2 + 3 + 3 + 2
    assert one(["Cat"])[1].tolist() != one(["CAT"])[1].tolist()


def test_quality_ftrl_by_brute_force():
    """The sparse learner equals a plain one that walks every coordinate."""
    rnd = random.Random(5)
    rows = [sorted(rnd.sample(range(30), 4)) for _ in range(25)]
    y = np.array([float(3 in r or 7 in r) for r in rows])
    model = quality_model.learn([np.array(r) for r in rows], [np.full(4, 0.5)] * 25, y)
    z, n, q = [0.0] * 31, [0.0] * 31, quality_model

    def weight(i):
        l1 = 0.0 if i == 30 else q.L1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((q.BETA + n[i] ** 0.5) / q.ALPHA + q.L2)

    for epoch in range(q.EPOCHS):
        for i in np.random.default_rng(epoch).permutation(25):
            x = {**{b: 0.5 for b in rows[i]}, 30: 1.0}
            w = {b: weight(b) for b in x}
            p = 1 / (1 + np.exp(-sum(w[b] * x[b] for b in x)))
            for b in x:
                g = (p - y[i]) * x[b]
                z[b] += g - ((n[b] + g * g) ** 0.5 - n[b] ** 0.5) / q.ALPHA * w[b]
                n[b] += g * g
    dense = model.dense()
    assert np.allclose([*dense[:30], model.bias], [weight(i) for i in range(31)]) and not dense[30:].any()


def test_quality_edges(spark, frame):
    rows = [(1, None), (2, ""), (3, "good words here"), (3, "good words here"), (None, "bad*** words###"), (5, "w " * 40000), (6, "bad*** more###")]
    labels = spark.createDataFrame([(3, 1, 9), (6, 0, 9), (6, None, 9), (None, 1, 9), (99, 0, 9)], "doc_id long, quality int, text int")
    got = quality_model.score(frame(rows), quality_model.fit(frame(rows), labels)).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.score)
    assert by[1] == by[2] and len(by[3]) == 1
    nothing = quality_model.fit(frame(rows), labels.limit(0))
    assert {r.score for r in quality_model.score(frame(rows), nothing).collect()} == {0.5}
    one = quality_model.fit(frame(rows), labels.filter("quality = 1"))
    assert min(r.score for r in quality_model.score(frame(rows), one).collect()) > 0.9
    assert quality_model.score(frame(rows).limit(0), one).collect() == []
    assert quality_model.labelled_sample(frame(rows), labels, 1).count() == 1


# --- hard negatives ---------------------------------------------------------------------------

def mined_by_hand(rows, every, low=80):
    rows = sorted({i: (i, k, v) for i, k, v in sorted(rows, reverse=True)}.values())
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for a, label, v in rows:
        if a % every:
            continue
        near = sorted((-dot(v, w), b, k) for b, k, w in rows if b != a)
        for s, p, _ in [x for x in near if x[2] == label][:5]:
            found = [(t, b) for t, b, k in near if k != label and low * -s <= 100 * -t <= 100 * -s][:5]
            out |= {(a, p, n + 1, b, -s, -t) for n, (t, b) in enumerate(found)}
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, k, v, "x", 1) for i, k, v in rows], "vec_id long, label int, embedding array<long>, leaf string, v int").repartition(3)


@pytest.mark.parametrize("kind", ["random", "ties", "clusters", "long", "equal"])
def test_hard_negatives_by_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", 20)
    monkeypatch.setattr(hard_negatives, "CHUNK", 16)
    monkeypatch.setattr(hard_negatives, "FANOUT", 4)
    rnd = random.Random(kind)
    centre = [[rnd.randint(-200, 200) for _ in range(6)] for _ in range(5)]
    make = {"random": lambda i: [rnd.randint(-99, 99) for _ in range(6)], "ties": lambda i: [rnd.randint(-1, 1) for _ in range(3)],
            "clusters": lambda i: [c + rnd.randint(-3, 3) for c in centre[rnd.randrange(5)]],
            "long": lambda i: [rnd.randint(-10 ** 6, 10 ** 6) for _ in range(6)], "equal": lambda i: [3, 4]}[kind]
    rows = [(i, rnd.randrange(3), make(i)) for i in range(300)]
    got = [tuple(r) for r in hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 10 == 0, sample_rows=150).collect()]
    assert len(got) == len(set(got)) and set(got) == mined_by_hand(rows, 10) and (kind == "random" or got)


def test_hard_negatives_leave_subtrees_out(spark, monkeypatch):
    """On clustered vectors most leaves are eliminated by their distance ranges."""
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", 50)
    rnd = np.random.default_rng(3)
    centre = rnd.integers(-300, 300, (12, 8))
    v = centre[rnd.integers(0, 12, 1200)] + rnd.integers(-4, 5, (1200, 8))
    rows = [(i, int(rnd.integers(0, 2)), x) for i, x in enumerate(v.tolist())]
    tree, placed = hard_negatives.build(vectors(spark, rows), 400)
    some = v[::100].astype(tree.kind)
    own = (some.astype(int) ** 2).sum(axis=1)[:, None]
    visits = sum(len(at) for _, at in tree.remaining(some, (own * 0.95).astype(np.int64), own))
    assert tree.leaves > 8 and visits < 0.4 * tree.leaves * len(some)
    assert placed.count() == 1200


def test_hard_negatives_edges(spark):
    base = [(0, 1, [1, 2]), (0, 1, [1, 2]), (1, 1, [2, 2]), (2, 2, [1, 1]), (3, 2, []), (4, 1, [1, 2, 5]), (5, 2, [1])]
    odd = [(None, 1, [1, 1]), (6, None, [1, 1]), (7, 1, None), (8, 1, [None, 1])]
    padded = [(i, k, v + [0] * (3 - len(v))) for i, k, v in base]
    got = {tuple(r) for r in hard_negatives.mine(vectors(spark, base + odd), F.col("vec_id") % 2 == 0, low=10).collect()}
    assert got and got == mined_by_hand(padded, 2, 10)
    assert hard_negatives.mine(vectors(spark, base).limit(0), F.lit(True)).collect() == []
    assert hard_negatives.mine(vectors(spark, base), F.lit(False)).collect() == []
    assert hard_negatives.mine(vectors(spark, [(1, 1, [1]), (2, 2, [1])]), F.lit(True)).collect() == []
    with pytest.raises(ValueError):
        hard_negatives.mine(vectors(spark, [(1, 1, [2 ** 27]), (2, 1, [1])]), F.lit(True))
    floats = spark.createDataFrame([(1, 1, [0.5, -0.1]), (2, 1, [float("nan"), 1.0]), (3, 1, [float("inf"), 1.0]), (4, 1, [None, 1.0])],
                                   "vec_id long, label int, embedding array<float>")
    assert [r.embedding for r in hard_negatives.whole_numbers(floats, 256).collect()] == [[128, -26]]


# --- spelling variants ------------------------------------------------------------------------

def variants_by_hand(rows):
    count, near, holes, form = Counter(), defaultdict(set), defaultdict(set), {}
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    count = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    for w in count:
        for k in range(len(w)):
            rest = w[:k] + w[k + 1:]
            holes[k, rest].add(w)
            if rest in count:
                near[w].add(rest)
                near[rest].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    for w, n in count.items():
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best and count[best] >= 10 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), count.get(form[w])) for w, n in count.items()}


def spoiled(rnd, w, letters):
    k = rnd.randrange(len(w))
    return rnd.choice([w[:k] + w[k + 1:], w[:k] + rnd.choice(letters) + w[k:], w[:k] + rnd.choice(letters) + w[k + 1:]])


@pytest.mark.parametrize("letters", ["abcdefghijklmnop", "ab", "éßÀ÷xYZ"])
def test_variants_by_brute_force(spark, frame, monkeypatch, letters):
    monkeypatch.setattr(spelling_variants, "SUBTRIE", 20)
    monkeypatch.setattr(spelling_variants, "CHUNK", 16)
    rnd = random.Random(letters)
    words = ["".join(rnd.choice(letters) for _ in range(rnd.choice([6, 7, 8, 12, 31, 32, 33, 60]))) for _ in range(30)]
    words += [spoiled(rnd, w, letters) for w in words for _ in range(4)]
    words += [spoiled(rnd, w, letters) for w in words[30:80]]
    pool = [w for k, w in enumerate(words) for _ in range(40 if k < 15 else 3 if k % 3 else 2)]
    rnd.shuffle(pool)
    rows = [(i, " ".join(pool[k:k + 20])) for i, k in enumerate(range(0, len(pool), 20))]
    got = [tuple(r) for r in spelling_variants.variants(frame(rows)).collect()]
    want = variants_by_hand(rows)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[4] for r in want) and any(r[1] for r in want)


def test_variants_chain_and_edges(spark, frame):
    rows = [(i, "abcdefgh " * 1000 + "abcdefgX " * 60 + "abcdefXX " * 4) for i in range(3)]
    rows += [(None, "nulls too nullses nullses"), (9, None), (10, ""), (11, "q" * 3000 + " " + "q" * 3000 + "\n" + "q" * 3001), (12, "q" * 3001),
             (13, "x" * 40000 + " " + "x" * 40000), (14, "a1bcdefg,HÉLLÖSÄ héllÖsÄ HÉLLÖSÄ")]
    rows += [rows[-1]]
    got = {tuple(r) for r in spelling_variants.variants(frame(rows)).collect()}
    assert got == variants_by_hand(rows)
    roots = {r[0]: r[2] for r in got}
    assert roots["abcdefxx"] == roots["abcdefgx"] == "abcdefgh"
    assert spelling_variants.variants(frame(rows).limit(0)).collect() == []
    assert spelling_variants.variants(frame([(1, "short words only")])).collect() == []


def test_near_is_one_edit():
    rnd = random.Random(8)
    for _ in range(3000):
        a = "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 6)))
        b = "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 6)))
        one = {a[:k] + a[k + 1:] for k in range(len(a))} | {a[:k] + c + a[k:] for k in range(len(a) + 1) for c in "ab"}
        one |= {a[:k] + c + a[k + 1:] for k in range(len(a)) for c in "ab"}
        assert spelling_variants.is_near(a.encode(), b.encode()) == (b in one - {a})
