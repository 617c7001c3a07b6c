"""Plain Python versions of the operators, for small tables."""

import re
from collections import Counter

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def shingle_set(text, size):
    w = words(text)
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1))


def components(rows, size, percent):
    """{doc_id: (set size, smallest id reachable)} of rows (doc_id, text)."""
    sets = [(d, shingle_set(t, size)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {d: (len(s), root(d)) for d, s in sets}


def removed_lines(rows, percent=80):
    """{doc_id: [line numbers]} of rows (doc_id, text): lines like an earlier one as bags of words."""
    earlier, out = [], {}
    for d, text in sorted(rows, key=lambda r: r[0]):
        out[d] = []
        for i, line in enumerate((text or "").split("\n")):
            bag = Counter(words(line))
            size = bag.total()
            if not size:
                continue
            for other, total in earlier:
                if min(size, total) * 100 >= percent * max(size, total):
                    shared = (bag & other).total()
                    if 100 * shared >= percent * (size + total - shared):
                        out[d].append(i)
                        break
            earlier.append((bag, size))
    return out


def cut_repeats(rows, length=100):
    """{doc_id: (bytes left, bytes, removed, spans)}."""
    seen, out = set(), {}
    for d, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if raw[i:i + length] in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(raw[i:i + length])
        spans = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (bytes(b for b, g in zip(raw, gone) if not g), len(raw), sum(gone), spans)
    return out


def leaked(text, item, size=5, percent=80):
    split = lambda t: re.findall(r"[a-z0-9'\x80-\U0010ffff]+", t.lower())
    bag = lambda w: Counter([tuple(w[i:i + size]) for i in range(len(w) - size + 1)] or ([tuple(w)] if w else []))
    d, k = split(text), split(item)
    want = bag(k)
    for s in range(max(1, len(d) - len(k) + 1)):
        got = bag(d[s:s + len(k)])
        shared = sum((got & want).values())
        if shared and 100 * shared >= percent * (got.total() + want.total() - shared):
            return True
    return False
