import random

import numpy as np
import pytest

from eventwatch.llm import html_text, language_id, sentencepiece_bpe, toxicity
from eventwatch.llm.toxicity import maximal_segments

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    path = sentencepiece_bpe.public_model()
    return sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_bpe.bpe(path)


def test_encoding_equals_the_library(library):
    sp, mine = library
    rnd = random.Random(2)
    letters = list(" a bcdethe\n\t▁é日1 23'  .,x　\x00ÿ😀ﬁ<>s_ing")
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(4000)]
    texts += [" " * k for k in range(40)] + ["a" + " " * k + "b" for k in range(40)] + ["a" * k for k in range(40)] + ["the" * 500]
    texts += ["".join(chr(rnd.choice([rnd.randint(1, 0xd7ff), rnd.randint(0xe000, 0x10ffff)])) for _ in range(9)) for _ in range(500)]
    ids = mine.encode(texts)
    want = sp.encode(texts, add_bos=True, add_eos=True)
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == want
    assert mine.decode(ids) == [sp.decode(w) for w in want]


def test_decoding_any_ids_equals_the_library(library):
    sp, mine = library
    rnd = random.Random(3)
    ids = [[rnd.choice([rnd.randint(0, 31999), rnd.randint(3, 258), rnd.randint(255, 262), 0, 1, 2]) for _ in range(rnd.randint(0, 12))]
           for _ in range(3000)]
    assert mine.decode([np.array(i, "<u4").tobytes() for i in ids]) == [sp.decode(i) for i in ids]


def test_token_rows(spark, frame):
    rows = [(1, None), (2, ""), (3, "the cat"), (3, "the cat"), (None, "x\n\ny")]
    got = sentencepiece_bpe.token_ids(frame(rows), sentencepiece_bpe.public_model()).collect()
    assert len(got) == 5 and all(r.same for r in got) and sum(len(r.ids) == 2 for r in got) == 2
    assert sentencepiece_bpe.encode_decode(frame(rows).limit(0), sentencepiece_bpe.public_model()).collect() == []


def test_maximal_segments_by_brute_force():
    """Each found segment is the best of the stretch left of it, recursively."""
    def brute(scores, base=0):
        best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0,))
        if best[0] <= 0:
            return []
        i = -best[2]
        j = i - best[1]
        return brute(scores[:i], base) + [(base + i, base + j, best[0])] + brute(scores[j:], base + j)

    rnd = random.Random(4)
    for _ in range(200):
        s = [rnd.choice([-3, -2, -1, 1, 2, 5]) + rnd.random() / 64 for _ in range(rnd.randint(0, 14))]
        at = np.flatnonzero(np.array(s) > 0) if s else np.zeros(0, int)
        total = np.r_[0.0, np.cumsum(s)]
        got = maximal_segments(at, np.array(s)[at] if s else at, total[at])
        assert [(a, b, round(v, 6)) for a, b, v in got] == [(a, b, round(v, 6)) for a, b, v in brute(s)]


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").filter("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").collect()
    right = [r.predicted == r.toxic for r in rows]
    assert len(rows) > 50 and sum(right) / len(right) > 0.9
    assert all((r.predicted == 1) == (r.score >= 0.3) for r in rows)


def test_toxicity_edges(spark, frame):
    docs = frame([(1, None), (2, ""), (3, "you idiot"), (3, "you idiot")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, none)).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    odd = spark.createDataFrame([(3, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, odd)).collect() == []
    kept = toxicity.without_toxic(docs, toxicity.fit(docs, none))
    assert kept.columns == docs.columns and kept.count() == 4


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(docs, language_id.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    rows = got.filter("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "12 !?", "en"), (4, "wort 😀 𐐀", None), (4, "wort", None)], "doc_id long, text string, lang string")
    got = language_id.identify(docs, language_id.fit(docs.filter("lang is null"))).collect()
    assert len(got) == 5 and all(r.lang_pred == "und" and r.score == 0 for r in got)
    assert language_id.identify(docs.limit(0), language_id.fit(docs.limit(0))).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><p>Site head</p></header>
<nav><ul><li>Home<li>News</ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>The &amp; title</h1></header><p>One <b>two<br>three</b>&nbsp;four<p>Five<script>var x="</p>";</script> six
<aside>Side</aside><form><input>Send</form><ul><li>a<li>b</ul><div id="comments"><p>First!</p></div></article>
<div class="ad">Buy</div><footer>&copy; 2024</footer>{}"""


def test_marked_article(spark):
    pages = spark.createDataFrame([(1, "http://h/1", PAGE.format("</body></html>")), (2, None, PAGE.format("")), (3, "http://h/3", None), (3, "http://h/3", "")],
                                  "page_id long, url string, html string")
    rows = sorted(((r.page_id, r.text, r.n_chars) for r in html_text.main_text(pages).collect()))
    want = "The & title\nOne two three four\nFive six\na\nb"
    assert rows == [(1, want, len(want)), (2, want, len(want)), (3, "", 0), (3, "", 0)]


def test_repeated_runs_of_a_host(spark):
    """Pages without a marked article lose what repeats on their host and nothing else."""
    rnd = random.Random(6)
    prose = lambda: " ".join(str(rnd.randint(0, 9 ** 9)) for _ in range(30))
    menu, rights = "<div>" + "".join(f"<a>item {i} </a>" for i in range(12)) + "</div>", "<div>all rights reserved by the owner of this fine site</div>"
    texts = [prose() for _ in range(6)]
    pages = [(i, f"http://host{i // 4}/{i}", f"<body>{menu}<div><p>{t}</p></div>{rights}</body>") for i, t in enumerate(texts)]
    pages.append((9, "http://alone/", f"<body><div>{texts[0]}</div></body>"))
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {**dict(enumerate(texts)), 9: texts[0]}


def test_copied_pages_keep_their_text(spark):
    """Copies of a page under other urls of its host do not erase each other."""
    rnd = random.Random(16)
    texts = [" ".join(str(rnd.randint(0, 9 ** 9)) for _ in range(30)) for _ in range(3)]
    menu = "<div>" + "".join(f"<a>item {i} </a>" for i in range(12)) + "</div>"
    pages = [(i, f"http://h/{i}", f"<body>{menu}<div><p>{texts[i % 3]}</p></div></body>") for i in range(5)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: texts[i % 3] for i in range(5)}


@pytest.mark.parametrize("page, want", [
    ('<div class="layout with-sidebar"><nav>menu</nav><article>Whole</article></div>', "Whole"),
    ('<article class="post comments-open"><p>One<div class="comment-list"><article class="comment">Me!</article></div></article>', "One"),
    ('<section id="notice-of-meeting"><p>Monday</section><footer>f</footer>', "Monday"),
    ('<article><div class="entry-header"><h1>Title</h1></div><p>Text</article>', "Title\nText"),
    ('<form id="page"><nav>n</nav><p>All</form>', "All"),
    ('<form><article>A<form>Send</form></article></form>', "A"),
    ('<div class="sidebar"><article>Card</article></div><article>Main</article>', "Main"),
    ('<div id="notices"><article>Only</article></div>', "Only"),
    ('<div class="site-header">h</div><main><p>M<div class="ad-slot">Buy</div></main>', "M"),
    ("<nav>only menus</nav>", ""), ("", ""),
])
def test_markup_is_evidence_only(page, want):
    blocks, is_open = html_text.blocks_of(page)
    assert "\n".join(html_text.kept_blocks(blocks, html_text.OTHER if is_open else html_text.CONTENT, [])) == want


def _pages(spark, rows):
    """Pages with columns that clash with the operator's own names."""
    return spark.createDataFrame([(i, u, h, "x", 1, 2, b"k") for i, u, h in rows],
                                 "page_id long, url string, html string, host string, part int, n int, key binary").repartition(5)


def _repeats_by_force(pages):
    """Text of each page by the definition: strings of RUN tokens, compared as strings, on all pages of a host."""
    parsed = {i: (u.split("/")[2], *html_text.blocks_of(h)) for i, u, h in pages}

    def runs(blocks):
        out, stream = {}, [(w, r) for t, r in blocks for w in t.split()]
        for k in range(len(stream) - html_text.RUN + 1):
            part = stream[k:k + html_text.RUN]
            if len({r for _, r in part}) == 1:
                out[k] = " ".join(w for w, _ in part)
        return out

    result = {}
    for i, (host, blocks, is_open) in parsed.items():
        keys, having = set(), {}
        for h, other, _ in sorted((p for p in parsed.values() if p[0] == host), key=str):
            if html_text.page_key(other) not in keys:
                keys.add(html_text.page_key(other))
                for r in set(runs(other).values()):
                    having[r] = having.get(r, 0) + 1
        least = html_text.OPEN_PAGES if is_open else html_text.MARKED_PAGES
        hit = {k + j for k, r in runs(blocks).items() if 2 * having.get(r, 0) > len(keys) and having.get(r, 0) >= least
               for j in range(html_text.RUN)}
        at, lines = 0, []
        for t, r in blocks:
            words = t.split()
            covered = [at + j in hit for j in range(len(words))]
            at += len(words)
            j = 0
            while j < len(words):
                end = j
                while end < len(words) and covered[end]:
                    end += 1
                if covered[j] and end - j < min(html_text.RUN, len(words)):
                    covered[j:end] = [False] * (end - j)
                j = max(end, j + 1)
            left = [w for w, c in zip(words, covered) if not c]
            if left and r == (html_text.OTHER if is_open else html_text.CONTENT):
                lines.append(" ".join(left))
        result[i] = "\n".join(lines)
    return result


@pytest.mark.parametrize("group", [1024, 4])
def test_host_repeats_by_brute_force(spark, monkeypatch, group):
    """Boilerplate in and out of articles, whole blocks, parts of blocks and over blocks; one and several groups a host."""
    monkeypatch.setattr(html_text, "GROUP", group)
    rnd = random.Random(26)
    prose = lambda n: " ".join(rnd.choice("abcdefghij") + str(rnd.randint(0, 400)) for _ in range(n))
    share, start, few, quoted = prose(12), prose(9), prose(5) + "</p><p>" + prose(6), prose(20)
    pages = []
    for i in range(60):
        body = [f"<p>{prose(rnd.randint(30, 50))}</p>" for _ in range(2)]
        body.append(f"<p>{start} {prose(rnd.randint(1, 9))}</p>" if i % 4 else f"<p>{prose(3)}</p>")
        body.append(f"<div><p>{few}</p></div>" if i % 5 else "")
        body.append(f"<blockquote>{quoted}</blockquote>" if i % 3 == 0 else "")
        body.append(f"<p>{share}</p>")
        text = "".join(body)
        pages.append((i, f"http://H{'abc'[min(i // 28, 2)]}.org/{i}", f"<article>{text}</article><p>x" if i % 2 else f"<div>{text}</div>"))
    pages += [(100 + k, f"https://ha.org/copy{k}", pages[3][2]) for k in range(30)]
    pages = [(i, u.lower(), h) for i, u, h in pages]
    rows = html_text.main_text(_pages(spark, pages)).collect()
    got, want = {r.page_id: r.text for r in rows}, _repeats_by_force(pages)
    assert len(rows) == len(pages) and got == want
    assert share not in got[1] and start not in got[1] and quoted in got[3] and all(got.values())


def test_result_does_not_depend_on_the_number_of_groups(spark, monkeypatch):
    """A string on half of a host's pages, nearly all of them in one of two groups, and only in one of them in kept text."""
    rnd = random.Random(7)
    line, menu = " ".join(f"shared{k}" for k in range(10)), " ".join(f"menu{k}" for k in range(10))
    made = {0: [], 1: []}
    while min(map(len, made.values())) < 70:
        own = "<p>" + " ".join(f"w{rnd.randint(0, 10 ** 6)}" for _ in range(30)) + "</p>"
        same = made[html_text.page_key(html_text.blocks_of(own)[0]) % 2]
        if len(same) < 70:
            same.append(own)
    pages = []
    for odd, texts in made.items():
        for k, own in enumerate(texts):
            shared = f"<p>{line}</p>" if not odd or k < 10 else ""
            bar = f"<p>{menu}</p>" if odd and k < 10 else f"<nav>{menu}</nav>"
            pages.append((len(pages), f"http://h.org/{len(pages)}", own + shared + bar))
    want = _repeats_by_force(pages)
    assert not any(line in t or menu in t for t in want.values())
    for group in (1024, 70):
        monkeypatch.setattr(html_text, "GROUP", group)
        assert {r.page_id: r.text for r in html_text.main_text(_pages(spark, pages)).collect()} == want


def test_html_edges(spark):
    """Long pages, repeated rows, null urls and ids, clashing columns, no pages."""
    word = "w" * 50 + " "
    rows = [(1, "http://u@h/1", f"<article>{word * 40000}</article>"), (2, "//h/2", "<p>a<p>b"), (2, "//h/2", "<p>a<p>b"), (None, None, "<p>same text " + "q " * 9),
            (4, None, "<p>same text " + "q " * 9), (5, "no host", None)]
    got = html_text.main_text(_pages(spark, rows)).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == sorted([(1, 51 * 40000 - 1), (2, 3), (2, 3), (0, 27), (4, 27), (5, 0)])
    assert all(set(r.asDict()) == {"page_id", "url", "text", "n_chars"} for r in got)
    assert html_text.main_text(_pages(spark, rows).limit(0)).collect() == []


def test_pages_of_the_test_data(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = html_text.main_text(pages).join(pages.select("page_id", "html"), "page_id").collect()
    for r in rows:
        inner = r.html.split("<article>")[1].split("</article>")[0]
        assert r.text and r.n_chars == len(r.text) and "<" not in r.text.replace("<", "", inner.count("&lt;"))
    assert html_text.main_text(pages.limit(0)).collect() == []
