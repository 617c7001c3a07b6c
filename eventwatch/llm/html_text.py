"""Main text of HTML pages (operator 5).

Pages are cut into text blocks with the region they stand in. Markup is evidence only: a page's article
is what article, main or role=main holds, without navigation, asides, footers, forms, hidden elements and
blocks whose whole class or id names boilerplate; names on an element around the article, or on the article
itself, are only believed while another article is left. Pages without such elements keep all blocks that
no markup speaks against.

Then the hosts' repeats go. A page's tokens, cut between regions, are one stream; every suffix of it counts by
its first `RUN` tokens, all that a depth-limited order needs: a string of RUN or more tokens repeats on some
pages exactly if each of its runs does, so the union of repeated runs is the union of the longest repeated
strings. A run is boilerplate on a host when more than half of its distinct pages have it, at least
`OPEN_PAGES` of them, `MARKED_PAGES` within a marked article. Covered stretches of RUN tokens or more, and
blocks covered whole, are cut; every other token stays. Pages are distinct when the smallest run hashes of
their longest blocks differ, so copies, and most near copies, count as one and do not erase each other.

Distinct pages of a host are dealt by that hash into groups of about `GROUP`, each counted in one task; runs
with a quarter of a group's pages are sent on and summed (all runs of a small group, which only copies leave behind). A run
that some groups did not send and whose sum is not decided without them is counted again in all groups, so the result
does not depend on the number of groups. Copies are combined before they are shuffled, so one host with
a third of all pages, or one page with very many copies, spreads over many tasks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from eventwatch.llm.text_arrays import mix, range_hashes, signed, small_batches
from eventwatch.session import materialize

RUN = 8
#: Distinct pages that must have a run, besides half of the host's: on pages without an article, and in articles.
OPEN_PAGES, MARKED_PAGES = 2, 5
#: Pages of a host that are counted together.
GROUP = 1024
#: Groups with fewer distinct pages send all their runs, where the host has more groups.
SMALL_GROUP = 64
#: Bytes of text a task holds to combine copies before it sends them.
HELD_BYTES = 32 << 20

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template iframe object svg math select option textarea button canvas audio video title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split())
BOILERPLATE = frozenset("nav aside footer menu dialog".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices popup "
    "promo promotion related respond share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split())
#: May stand beside a boilerplate name in a compound name: "site-header", "comment-list".
NEUTRAL_NAMES = frozenset(
    "area bar block bottom box container global inner item items left link links list main outer page panel post posts right row "
    "section site slot thread top wrap wrapper".split())
#: Text of these is raw up to the end tag.
RAW = "script|style|noscript|template|iframe|textarea|title|svg"

_PIECE = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<({RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|[^<]+|<", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
_NAME_PART = re.compile(r"[a-z0-9]+")
CONTENT, MARKED, OTHER = 2, 1, 0


def _is_boilerplate_name(name: str) -> bool:
    """A boilerplate name, alone or with neutral ones: not "with-sidebar", "comments-open", "entry-header"."""
    parts = _NAME_PART.findall(name)
    return any(p in BOILERPLATE_NAMES for p in parts) and all(p in BOILERPLATE_NAMES or p in NEUTRAL_NAMES or p.isdigit() for p in parts)


def _region(tag: str, attributes: str) -> tuple[bool, bool, bool, bool]:
    """(boilerplate by element or role, boilerplate by name, article, main) as this start tag declares."""
    hard, soft, article, main = tag in BOILERPLATE or tag in HIDDEN, tag == "form", tag == "article", tag == "main"
    if attributes.strip():
        for name, a, b, c, bare in _ATTRIBUTE.findall(attributes):
            value = (a or b or c).lower()
            key = (name or bare).lower()
            if key == "role":
                # a form may hold a whole page
                soft |= value == "form"
                hard |= value in BOILERPLATE_ROLES and value != "form"
                main |= value == "main"
            elif key in ("class", "id"):
                soft |= tag not in ("html", "body", "main") and any(_is_boilerplate_name(v) for v in value.split())
            elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                hard = True
            elif key == "style":
                hard |= "display:none" in value.replace(" ", "")
    return hard, soft, article, main


#: What stands open around a text: boilerplate by element, by name outside and inside an article, article, main.
_TOP = (False, False, False, False, False)


def blocks_of(page: str) -> tuple[list[tuple[str, int]], bool]:
    """([(text, region)], open): text blocks in page order; open when the page marks no article."""
    found: list[tuple[str, tuple[bool, ...]]] = []
    stack: list[tuple[str, tuple[bool, ...]]] = []
    parts: list[str] = []
    now = _TOP

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append((text, now))
            parts.clear()

    for m in _PIECE.finditer(page):
        tag = m[3]
        if tag is None:
            piece = m[0]
            if m[1] is None and not piece.startswith("<"):
                parts.append(piece)
            elif piece == "<":
                parts.append("&lt;")
            continue
        tag = tag.lower()
        block = tag in BLOCK
        if block:
            flush()
        elif tag == "br":
            parts.append(" ")
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag not in VOID and not m[4].rstrip().endswith("/"):
            if block and stack and stack[-1][0] == "p":
                stack.pop()
            if tag in ("li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == tag:
                stack.pop()
            hard, outside, inside, in_article, in_main = stack[-1][1] if stack else _TOP
            is_hard, is_soft, article, main = _region(tag, m[4])
            # a page header is boilerplate, a header inside the article is part of it
            is_hard |= tag == "header" and not (in_article or in_main)
            if in_article or in_main:
                # an article within the article that is named a comment is one
                inside |= is_soft
            else:
                outside |= is_soft
            stack.append((tag, (hard or is_hard, outside, inside, in_article or article, in_main or main)))
        now = stack[-1][1] if stack else _TOP
    flush()
    # the best reading that leaves anything: names outside the article count first, then they do not
    for trusted in (True, False):
        for kind in (3, 4):
            content = [bool(f[kind] and not f[0] and not f[2] and not (trusted and f[1])) for _, f in found]
            if any(content):
                return [(t, CONTENT if c else OTHER if not (f[0] or f[1] or f[2]) else MARKED) for (t, f), c in zip(found, content)], False
    for trusted in (True, False):
        regions = [MARKED if f[0] or (trusted and (f[1] or f[2])) else OTHER for _, f in found]
        if OTHER in regions:
            break
    return [(t, r) for (t, _), r in zip(found, regions)] if found else [], True


def host_of(url: Column) -> Column:
    """Host of a url in lower case, without user; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#]*)", 1)), F.lit(""))


def run_hashes(blocks: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of each RUN consecutive tokens of the page that lie in one region."""
    tokens = [t.split(" ") for t, _ in blocks]
    raw = [w.encode("utf-8", "surrogatepass") for words in tokens for w in words]
    if len(raw) < RUN:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.cumsum([len(w) for w in raw])
    words = range_hashes(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, ends[:-1]], ends)
    out = mix(words[:len(words) - RUN + 1] + np.uint64(RUN))
    for k in range(1, RUN):
        out = mix(out * np.uint64(3) + words[k:len(words) - RUN + 1 + k])
    region = np.repeat([r for _, r in blocks], [len(w) for w in tokens])
    breaks = np.r_[0, np.cumsum(region[1:] != region[:-1])]
    at = np.flatnonzero(breaks[:len(out)] == breaks[RUN - 1:])
    return out[at], at


def page_key(blocks: list[tuple[str, int]]) -> int:
    """Smallest run hash of a page's longest block: copies and most near copies share it."""
    longest = max((t for t, _ in blocks), key=len, default="")
    hashes = run_hashes([(longest, OTHER)])[0]
    if not len(hashes):
        raw = longest.encode("utf-8", "surrogatepass")
        hashes = range_hashes(np.frombuffer(raw, np.uint8), np.zeros(1, np.int64), np.array([len(raw)]))
    return int(signed(hashes.min(keepdims=True))[0])


def distinct_pages(pages: DataFrame) -> DataFrame:
    """(host, parts, key, content, texts, regions) of the pages of a host, copies of a task combined: least content of each key."""
    def send(held: dict) -> pa.RecordBatch:
        rows = [(*at, *row) for at, row in held.items()]
        host, parts, key, content, texts, regions = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(host, pa.string()), pa.array(parts, pa.int64()), pa.array(key, pa.int64()), pa.array(content, pa.binary()),
             pa.array(texts, pa.list_(pa.string())), pa.array(regions, pa.list_(pa.int32()))],
            ["host", "parts", "key", "content", "texts", "regions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, int], tuple] = {}
        size = 0
        for batch in batches:
            for host, page, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                blocks, _ = blocks_of(page)
                texts = [t.encode("utf-8", "replace").decode() for t, _ in blocks]
                regions = [r for _, r in blocks]
                content = blake2b("\n".join(texts).encode() + bytes(regions), digest_size=16).digest()
                at = (host, parts, page_key(blocks))
                if at not in held or content < held[at][0]:
                    held[at] = (content, texts, regions)
                    size += sum(map(len, texts))
                if size > HELD_BYTES:
                    yield send(held)
                    held, size = {}, 0
        if held:
            yield send(held)

    return pages.select("host", "html", "parts").mapInArrow(
        run, "host string, parts bigint, key bigint, content binary, texts array<string>, regions array<int>")


def _group_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, run, n, least, needed) of the runs of each group that `least` of its pages have; run null: its pages.

    Where `asked` runs are given, exactly those of them that the group has are counted.
    """
    def counted(host: str, parts: int, asked: list[int] | None, runs: list[np.ndarray], needed: list[np.ndarray]) -> pa.RecordBatch:
        every, n = np.unique(np.concatenate(runs), return_counts=True)
        if asked is not None:
            least, some = 1, np.flatnonzero(np.isin(signed(every), np.array(asked, np.int64)))
        else:
            # the only group of a host decides by itself
            least = max(OPEN_PAGES, len(runs) // 2 + 1) if parts == 1 else len(runs) // 4 + 1 if len(runs) >= SMALL_GROUP else 1
            some = np.flatnonzero(n >= least)
        return pa.RecordBatch.from_arrays(
            [pa.array([host] * (len(some) + 1), pa.string()), pa.array([None, *signed(every[some]).tolist()], pa.int64()),
             pa.array([len(runs), *n[some].tolist()], pa.int64()), pa.array([least] * (len(some) + 1), pa.int64()),
             pa.array([False, *np.isin(every[some], np.concatenate(needed)).tolist()], pa.bool_())],
            ["host", "run", "n", "least", "needed"])

    group, key, runs, needed = None, None, [], []
    for batch in batches:
        for host, part, parts, asked, k, texts, regions in zip(
                *(batch.column(c).to_pylist() for c in ("host", "part", "parts", "asked", "key", "texts", "regions"))):
            if group is None or group[:2] != (host, part):
                if group is not None:
                    yield counted(group[0], *group[2:], runs, needed)
                group, key, runs, needed = (host, part, parts, asked), None, [], []
            if k == key:
                continue
            key = k
            blocks = list(zip(texts, regions))
            hashes, at = run_hashes(blocks)
            kept = np.repeat(np.array(regions, np.int64) == (CONTENT if CONTENT in regions else OTHER), [len(t.split(" ")) for t in texts])
            runs.append(np.unique(hashes))
            needed.append(hashes[kept[at]])
    if group is not None:
        yield counted(group[0], *group[2:], runs, needed)


def host_repeats(pages: DataFrame) -> DataFrame:
    """(host, open_runs, marked_runs): hashes of the runs that are boilerplate on the host's pages.

    At most twice the runs of an average page of the host. A run that a group did not send has fewer than `least`
    pages there, so its sum lies between two bounds; where half of the host's pages lies between them too, the
    run is counted again in all groups of the host.
    """
    count = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def counts_of(chosen: DataFrame, name: str) -> DataFrame:
        dealt = distinct_pages(chosen).withColumn("part", F.pmod("key", "parts"))
        asked = chosen.select("host", "asked").distinct() if "asked" in chosen.columns else None
        dealt = dealt.withColumn("asked", F.lit(None).cast("array<bigint>")) if asked is None else dealt.join(asked, "host")
        groups = dealt.repartition(count, "host", "part").sortWithinPartitions("host", "part", "key", "content")
        return materialize(groups.mapInArrow(_group_counts, "host string, run bigint, n bigint, least bigint, needed boolean"), name)

    counts = counts_of(pages, "host-runs")
    sizes = counts.filter("run is null").groupBy("host").agg(
        F.sum("n").alias("pages"), F.count(F.lit(1)).alias("groups"), F.sum(F.col("least") - 1).alias("unsent"))
    runs = counts.filter("run is not null").groupBy("host", "run").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("sent"), F.sum(F.col("least") - 1).alias("below"), F.max("needed").alias("needed")).join(sizes, "host")
    # only a run that no group needs goes; where a group did not send it, that is not known
    runs = runs.filter(F.col("needed") | (F.col("sent") < F.col("groups")))
    at_most = F.col("n") + F.col("unsent") - F.col("below")
    doubtful = materialize(runs.filter((2 * F.col("n") <= F.col("pages")) & (2 * at_most > F.col("pages"))).groupBy("host").agg(
        F.sort_array(F.collect_list("run")).alias("asked")), "doubtful-runs")
    found = runs.filter(2 * F.col("n") > F.col("pages")).select("host", "run", "n")
    if not doubtful.isEmpty():
        again = counts_of(pages.join(doubtful, "host"), "host-runs-again").filter("run is not null").groupBy("host", "run").agg(F.sum("n").alias("n"))
        found = found.unionByName(again.join(sizes, "host").filter(2 * F.col("n") > F.col("pages")).select("host", "run", "n"))
    return found.filter(F.col("n") >= OPEN_PAGES).groupBy("host").agg(
        F.collect_list("run").alias("open_runs"),
        F.collect_list(F.when(F.col("n") >= MARKED_PAGES, F.col("run"))).alias("marked_runs"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages`.

    Null and empty html gives an empty text; pages without a host (null url) take no part in the search for
    repeats. Repeated rows give repeated results; other columns are ignored; an empty table gives no rows.
    White space is what Unicode calls so; br is white space, other block elements end a block. Pages of any
    length are read whole.
    """
    small_batches(pages.sparkSession)
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host_of(F.col("url").cast("string")).alias("host"))
    hosted = read.filter("host <> '' and html <> ''")
    # a written table has a known size: Spark only shuffles the pages for this join where it is large
    sizes = materialize(hosted.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts")), "host-sizes")
    repeats = materialize(host_repeats(hosted.join(sizes, "host")), "host-repeats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, in_open, in_marked in zip(*(batch.column(c).to_pylist() for c in ("html", "open_runs", "marked_runs"))):
                blocks, is_open = blocks_of(page)
                texts.append("\n".join(kept_blocks(blocks, OTHER if is_open else CONTENT, (in_open if is_open else in_marked) or [])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    joined = read.join(repeats, "host", "left").select("page_id", "url", "html", "open_runs", "marked_runs")
    return joined.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def kept_blocks(blocks: list[tuple[str, int]], region: int, runs: list[int]) -> list[str]:
    """The blocks of a region without the tokens that `runs` cover."""
    if not runs:
        return [t for t, r in blocks if r == region]
    hashes, at = run_hashes(blocks)
    at = at[np.isin(signed(hashes), np.array(runs, np.int64))]
    tokens = [t.split(" ") for t, _ in blocks]
    step = np.zeros(sum(map(len, tokens)) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + RUN, -1)
    hit = np.cumsum(step)[:-1] > 0
    out, first = [], 0
    for words, (_, r) in zip(tokens, blocks):
        covered = hit[first:first + len(words)].copy()
        first += len(words)
        if r != region:
            continue
        # a repeat may reach some common words into the next block: such ends stay
        edges = np.flatnonzero(np.diff(np.r_[0, covered.astype(np.int8), 0]))
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a < min(RUN, len(words)):
                covered[a:b] = False
        left = [w for w, c in zip(words, covered) if not c]
        if left:
            out.append(" ".join(left))
    return out
