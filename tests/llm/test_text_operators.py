import hashlib
import random
import zlib

import numpy as np
import pytest

import brute
from eventwatch.llm import decontaminate, line_dedup, ngram_join, set_join, suffix_dedup
from eventwatch.llm.quality_rules import quality_rules
from eventwatch.llm.sharding import permute, shard_documents


def test_suffix_dedup(frame, corpus):
    got = {r.doc_id: (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.cut_repeats(frame(corpus)).collect()}
    assert got == brute.cut_repeats(corpus)
    assert any(v[2] for v in got.values())


def test_suffix_runs_do_not_depend_on_slices():
    """A text gets the same runs alone and among others, and each string exactly one run."""
    rnd = np.random.default_rng(3)
    a, b = (rnd.integers(97, 101, n).astype(np.uint8) for n in (900, 700))
    alone = suffix_dedup.Runs(b, np.array([0, 700]))
    both = suffix_dedup.Runs(np.r_[a, b], np.array([0, 900, 1600]))
    at = both.row == 1
    assert (both.anchor[at] - 900 == alone.anchor).all() and (both.lo[at] - 900 == alone.lo).all()
    assert (alone.hi - alone.lo + 1).sum() == 700 - 99


def test_suffix_dedup_repeated_rows(frame):
    text = "".join(map(chr, np.random.default_rng(8).integers(97, 123, 260)))
    rows = suffix_dedup.cut_repeats(frame([(1, text), (1, text), (None, text), (2, None)])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in rows) == [(-1, 0), (1, 260), (1, 260), (2, 0)]


def test_suffix_dedup_repeated_rows_alone(frame):
    """Rows equal in doc_id and text are one document: they keep its text, but lose what repeats in it."""
    rnd = np.random.default_rng(9)
    a, b, c = ("".join(map(chr, rnd.integers(97, 123, n))) for n in (260, 300, 150))
    docs = [(1, a), (2, b + c + b), (3, c), (4, a[:200] + c[:90])]
    want = brute.cut_repeats(docs)
    assert want[1][2] == 0 and want[2][2] and want[3][2] and want[4][2]
    rows = suffix_dedup.cut_repeats(frame([docs[0], docs[0], *docs[1:], *docs[1:], docs[3]])).collect()
    got = sorted((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in rows)
    assert got == sorted((d, *want[d]) for d in (1, 1, 2, 2, 3, 3, 4, 4, 4))


def test_ngram_join(frame, corpus):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(frame(corpus)).collect()}
    assert got == brute.components(corpus, 4, 85)
    assert len({c for _, c in got.values()}) < len(got)


def test_ngram_join_chain_and_tiles(frame, monkeypatch):
    """A chain of links whose ends are not alike, in blocks larger than a tile."""
    monkeypatch.setattr(ngram_join, "TILE", 4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(30):
        rows.append((100 - k, " ".join(base)))
        base = [*base]
        base[(7 * k) % 120] = f"new{k}"
    got = {r.doc_id: r.component_id for r in ngram_join.link_components(frame(rows)).collect()}
    assert got == {d: c for d, (_, c) in brute.components(rows, 4, 85).items()}
    assert set(got.values()) == {71}


def test_ngram_join_edges(frame, spark):
    text = "a b c d e f"
    rows = ngram_join.link_components(frame([(5, text), (5, text), (None, text), (7, None), (8, "")])).collect()
    assert sorted(map(str, [(r.doc_id, r.n_shingles, r.component_id) for r in rows])) == sorted(
        map(str, [(5, 3, 5), (5, 3, 5), (None, 3, 5), (7, 0, 7), (8, 0, 8)]))
    kept = ngram_join.one_of_each(frame([(5, text), (5, text), (6, text), (7, None), (8, "")])).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == [5, 7, 8]


def test_line_dedup(frame, corpus, monkeypatch):
    monkeypatch.setattr(line_dedup, "TILE", 2)
    docs, want = frame(corpus), brute.removed_lines(corpus)
    got = {r.doc_id: r.removed for r in line_dedup.line_report(docs).collect()}
    assert got == want and any(want.values())
    left = {r.doc_id: r.text for r in line_dedup.without_lines(docs, line_dedup.removed_lines(docs)).collect()}
    for d, text in corpus:
        kept = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in want[d])
        assert left[d] == kept


def test_line_dedup_short_lines(frame):
    """Lines of one to four words take part like all others; lines without words stay."""
    rows = [(1, "one\nA b c\n\n \nw x y z"), (2, "a  B c\none two\n\none"), (3, "w x y z\nw x y\nw x y z v"), (4, "v w x y z\none two\none two\none one")]
    want = {1: [], 2: [0, 3], 3: [0, 2], 4: [0, 1, 2]}
    assert brute.removed_lines(rows) == want
    assert {r.doc_id: r.removed for r in line_dedup.line_report(frame(rows)).collect()} == want


def test_line_dedup_one_word_changed(frame):
    """A line of ten or more words with one word changed, added, removed or moved goes."""
    rnd = random.Random(5)
    rows, want = [], {}
    for k in range(40):
        w = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(10, 60))]
        edit, at = list(w), rnd.randrange(len(w))
        if k % 4 == 0:
            edit[at] = "other"
        elif k % 4 == 1:
            edit.insert(at, "other")
        elif k % 4 == 2:
            del edit[at]
        else:
            edit.insert(0, edit.pop(at))
        rows += [(2 * k, " ".join(w)), (2 * k + 1, "own line %d\n" % k + " ".join(edit))]
        want |= {2 * k: [], 2 * k + 1: [1]}
    got = {r.doc_id: r.removed for r in line_dedup.line_report(frame(rows)).collect()}
    brute_want = brute.removed_lines(rows)
    assert got == brute_want
    assert sum(got[d] == x for d, x in want.items()) >= 0.9 * len(want)


def test_line_dedup_many_near_copies(frame, monkeypatch):
    """Groups of look-alikes with more candidates than are tried first, in blocks cut into tiles."""
    monkeypatch.setattr(line_dedup, "TILE", 3)
    monkeypatch.setattr(line_dedup, "NEAREST", 1)
    rnd, asked, candidates = random.Random(6), [], line_dedup.candidates
    monkeypatch.setattr(line_dedup, "candidates", lambda *a: asked.append(len(a)) or candidates(*a))
    base = [f"w{i}" for i in range(200)]
    rows = []
    for d in range(60):
        w = list(base)
        for at in rnd.sample(range(200), rnd.randint(8, 20)):
            w[at] = f"x{rnd.randrange(1000)}"
        rows.append((d, " ".join(w)))
    want = brute.removed_lines(rows)
    assert {r.doc_id: r.removed for r in line_dedup.line_report(frame(rows)).collect()} == want
    assert 5 < sum(not x for x in want.values()) < 55 and asked == [3, 4]


def test_line_dedup_edges(frame):
    """Null ids come first, equal rows are one document, a very long line is compared whole."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30000))
    rows = [(None, "a b c"), (1, "a b c\nd e"), (1, "a b c\nd e"), (2, long), (3, long + " end"), (4, None), (5, "")]
    got = sorted(((r.doc_id, r.n_lines, r.removed) for r in line_dedup.line_report(frame(rows)).collect()), key=str)
    assert got == sorted([(None, 1, []), (1, 2, [0]), (1, 2, [0]), (2, 1, []), (3, 1, [0]), (4, 1, []), (5, 1, [])], key=str)


def test_line_dedup_blocks_are_sorted_by_one_number(frame, corpus, spark, monkeypatch):
    """Rows of blocks are sorted by one long, and rows without an element of an open class are not shuffled for them."""
    monkeypatch.setattr(line_dedup, "TILE", 3)
    docs = frame(corpus)
    reps = line_dedup.materialize(line_dedup.line_classes(docs, 80, line_dedup.word_counts(docs)), "line-classes")
    hot = line_dedup.materialize(spark.sql("select 1 token, 2 parts where false").selectExpr("int(token) token", "int(parts) parts"), "line-hot")
    none = line_dedup.materialize(spark.sql("select 1L id"), "line-open")
    for undecided in ((), (none,)):
        plan = line_dedup.candidates(reps, hot, 80, *undecided)._jdf.queryExecution().executedPlan().toString()
        sorts = [x.partition("]")[0] for x in plan.split("Sort [")[1:]]
        assert len(sorts) == 1 and sorts[0].startswith("key#") and "," not in sorts[0]
        assert plan.count("Exchange hashpartitioning(shiftright(key#") == 1 and "Exchange hashpartitioning(token" not in plan


def test_line_dedup_open_classes_meet_rows_within_their_length(frame, spark, monkeypatch):
    """Of the rows with an element of an open class, only those within its length limits are looked at."""
    def counted(batches, *_):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([0]), pa.array([False])], ["id", "other", "more"])

    lines = [" ".join(["common", *(f"w{k}x{i}" for i in range(k))]) for k in (9, 10, 11, 30, 60)]
    reps = line_dedup.line_classes(frame(list(enumerate(lines))), 80, np.zeros(line_dedup.BUCKETS, np.int64)).selectExpr(
        "id", "doc_id", "line", "body", "n", "array(7) prefix", "array(8) tail", "b1", "b2")
    reps, hot = line_dedup.materialize(reps, "line-classes"), spark.sql("select int(1) token, int(2) parts where false")
    monkeypatch.setattr(line_dedup, "_block_pairs", counted)
    got = line_dedup.candidates(reps, hot, 80, reps.filter("n = 11").select("id")).collect()
    # sizes 10, 11 and 12, for two elements that may come to one task
    assert [r.id for r in got] in ([3], [6])


def test_row_order():
    """The packed sort orders like all three columns, also where 37 bits do not tell two hashes apart."""
    rnd = np.random.default_rng(4)
    row, level = np.sort(rnd.integers(0, 9, 600)), rnd.integers(0, 128, 600).astype(np.uint64)
    hashes = rnd.integers(0, 1 << 63, 600, dtype=np.uint64)
    for low in (hashes, hashes & np.uint64(7), np.uint64(5) << np.uint64(60) | hashes & np.uint64(63)):
        at = set_join.row_order(row, level, low)
        assert [x.tolist() for x in (row[at], level[at], low[at])] == [x[np.lexsort((low, level, row))].tolist() for x in (row, level, low)]
        at = set_join.row_order(row, 0, low)
        assert low[at].tolist() == low[np.lexsort((low, row))].tolist()


def test_words_of_lines_number_lines():
    import pyarrow as pa
    from eventwatch.llm.text_arrays import utf8

    words, row, number = line_dedup.words_of_lines(*utf8(pa.array(["\n\na b\n", "c\nd e", None, "\n"])))
    assert [(r, n, int(k)) for r, n, k in zip(row.tolist(), number.tolist(), np.diff(words.first)) if k] == [(0, 2, 2), (1, 0, 1), (1, 1, 2)]


def test_decontamination(frame, spark, corpus):
    items = [(i, " ".join(t.replace("\n", " ").split(" ")[:k])) for i, (t, k) in enumerate(
        (t, k) for (_, t), k in zip([c for c in corpus if c[1] and len(c[1].split()) > 60][:6], (14, 20, 30, 40, 50, 59)))]
    items += [(90, None), (91, ""), (92, "two words"), (93, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame(corpus), bench).collect()}
    want = {(d, k) for d, t in corpus for k, item in items if t and item and brute.leaked(t, item)}
    assert got == want and len(got) >= 6
    left = {r.doc_id for r in decontaminate.without_leaks(frame(corpus), bench).collect()}
    assert left == {d for d, _ in corpus} - {d for d, _ in want}


def test_decontamination_of_reordered_passages(frame, spark):
    """Parts of an item in another order, inside a longer document."""
    rnd = np.random.default_rng(21)
    prose = lambda n: " ".join(f"w{x}" for x in rnd.integers(0, 10 ** 9, n))
    parts = [prose(30) for _ in range(2)]
    swapped = " ".join(parts[::-1])
    items = [(1, " ".join(parts)), (2, prose(50))]
    docs = [(1, f"{prose(100)} {swapped} {prose(100)}"), (2, f"{swapped} {prose(3)}"), (3, f"{prose(70)} {parts[1]} {prose(70)}"),
            (4, f"{prose(9)} {' '.join(items[1][1].split()[25:] + items[1][1].split()[:25])} {prose(80)}"), (5, swapped)]
    rows = decontaminate.find_leaks(frame(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(d, k) for d, t in docs for k, item in items if brute.leaked(t, item)}
    assert {(r.doc_id, r.item_id) for r in rows} == want and {(1, 1), (2, 1), (5, 1)} <= want
    assert {r.doc_id: r.first_word for r in rows}[1] == 100


def test_windows_over_shared_shingles():
    """Every start over a shared shingle once, and the prints of the windows one by one."""
    rnd = np.random.default_rng(22)
    row, place = rnd.integers(0, 4, 60), rnd.integers(0, 90, 60)
    size = rnd.choice([3, 5, 12, 40], 60)
    most = np.maximum(94 - size, 0)
    got = decontaminate.windows_over(row, size, place, most)
    want = {(r, s, min(max(x, 0), m)) for r, s, p, m in zip(row, size, place, most) for x in range(p - max(s - 5, 0), p + 1)}
    assert list(map(tuple, got)) == sorted(want)
    r, s, start = got.T
    h = rnd.integers(0, 1 << 63, 4 * 90, dtype=np.uint64)
    n, at = np.maximum(s - 4, 1), r * 90 + start
    n = np.minimum(n, 360 - at)
    head = np.r_[True, (r[1:] != r[:-1]) | (s[1:] != s[:-1]) | (start[1:] != start[:-1] + 1)]
    assert decontaminate.window_prints(h, at, n, head).tolist() == [decontaminate.fingerprint(h[a:a + k]) for a, k in zip(at, n)]


def test_decontamination_parts(frame, spark, corpus):
    """A benchmark used in several parts gives the same leaks."""
    bench = spark.createDataFrame([(i, t) for i, t in corpus if t], "item_id long, text string")
    parts = list(decontaminate.benchmark_parts(bench, 4000))
    assert len(parts) > 3 and sorted(i for p in parts for i in p.ids) == sorted(i for i, t in corpus if t)


def test_near_items_finds_every_print_within_the_radius():
    rnd = np.random.default_rng(5)
    bench = decontaminate.Benchmark(list(range(50)), [" ".join(f"w{rnd.integers(999)}" for _ in range(30)) for _ in range(50)])
    prints = rnd.integers(0, 1 << 63, 400, dtype=np.uint64)
    for i in range(200):
        prints[i] = bench.prints[i % 50] ^ np.bitwise_or.reduce(np.uint64(1) << rnd.choice(64, i % 25, replace=False).astype(np.uint64)) if i % 25 else bench.prints[i % 50]
    want = np.bitwise_count(prints[:, None] ^ bench.prints[None, :]) <= decontaminate.RADIUS
    assert (decontaminate.near_items(bench, prints) == want).all()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    assert sorted(permute(np.arange(n), n).tolist()) == list(range(n))


def test_sharding(frame, corpus):
    rows = [*corpus, corpus[0], corpus[0], (None, "x")]
    got = shard_documents(frame(rows)).collect()
    again = shard_documents(frame(rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(len(by.get(k, [])) for k in range(16)) <= 1
    for r in got:
        assert r.shard + 16 * r.slot == permute(np.array([r.row_number]), len(rows))[0]
    sizes = {(r.doc_id, r.size, r.text_crc32) for r in got}
    assert sizes == {(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows}


def test_quality_rules(frame, corpus):
    rows = [*corpus, (900, "the same eight words again and again here " * 9), (901, "a # b\n# * $ % & | < >\na # b"), (902, "the cat sat on " * 400)]
    for r in quality_rules(frame(rows)).collect():
        w = __import__("re").findall(r"[^\x20\x09-\x0D]+", dict(rows)[r.doc_id] or "")
        seen = {}
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i:i + 8]), []).append(i)
        covered = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(8)}
        lines = [x for x in (dict(rows)[r.doc_id] or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (
            len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in dict(rows)[r.doc_id] or "")
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and (not r.kept or not r.base_failed)


@pytest.mark.parametrize("run", [
    suffix_dedup.cut_repeats, ngram_join.link_components, ngram_join.one_of_each, line_dedup.line_report, shard_documents, quality_rules])
def test_empty_table(frame, run):
    assert run(frame([(1, "a")]).filter("doc_id < 0")).collect() == []


def test_sha_of_what_is_left(frame):
    text = "é" * 120
    (row,) = suffix_dedup.cut_repeats(frame([(1, text)])).collect()
    assert hashlib.sha256(row.kept).hexdigest() == hashlib.sha256(brute.cut_repeats([(1, text)])[1][0]).hexdigest()
