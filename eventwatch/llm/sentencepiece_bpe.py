"""SentencePiece BPE encoding and decoding by vectorised merge rounds (operator 2).

Texts are cut into words no piece reaches across, each distinct word of a slice is encoded once, and
all words of a slice are merged together: flat symbol arrays, the smallest pair rank per word by a
segmented minimum, every leftmost non-overlapping pair of that rank at once, compaction, until no
word has a pair left. The library serves only to read the vocabulary from the model file.

Supported models: BPE with identity normalisation and a dummy prefix (checked when loading).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from eventwatch.llm.text_arrays import id_and_text, lists, slices, within

SPACE = "▁"
UNKNOWN_TEXT = " ⁇ ".encode()
#: Distinct words a worker remembers; at the bound the memory starts anew, so it cannot grow with the data.
REMEMBERED = 400_000
_NONE = np.iinfo(np.int32).max


class Bpe:
    """Vocabulary tables of one model file and the two directions over them."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if [pieces[i] for i in sp.encode(" x")][:1] != [SPACE]:
            raise ValueError("only models with a dummy prefix and kept white space are supported")
        self.bos, self.eos, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.has_bytes = all(sp.is_byte(int(i)) for i in self.byte_ids)
        # symbols: the pieces by id, then characters that are only parts of pieces
        symbol = {pieces[i]: i for i in normal}
        used = sorted({c for i in normal for c in pieces[i]})
        for c in used:
            symbol.setdefault(c, n + len(symbol))
        self.characters = np.array([ord(c) for c in used], np.int64)
        self.character_symbols = np.array([symbol[c] for c in used], np.int64)
        self.n = n
        order = sorted({-sp.get_score(i) for i in normal})
        level = {s: k for k, s in enumerate(order)}
        rank = {i: level[-sp.get_score(i)] for i in normal}
        left, right, made = [], [], []
        for i in normal:
            p = pieces[i]
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i)
        # symbols outside the vocabulary get numbers from `stride` on and never pair
        self.stride = max(symbol.values()) + 1
        left, right, made = np.array(left), np.array(right), np.array(made)
        keys = left * self.stride + right
        at = np.argsort(keys)
        self.keys, self.made = keys[at], made[at]
        ranks = np.full(self.stride, _NONE, np.int32)
        ranks[list(rank)] = list(rank.values())
        self.ranks = ranks[self.made]
        # a rank whose result may pair again at no worse rank is merged one pair at a time
        single = np.zeros(len(order) + 1, bool)
        whole = ranks[made]
        for side in (left, right):
            again = (ranks[side] != _NONE) & (whole <= ranks[side])
            single[ranks[side][again]] = True
        self.single = single
        inner = any(SPACE in p.lstrip(SPACE) for p in symbol)
        if inner:
            raise ValueError("pieces with a space after other characters are not supported")
        self.pattern = re.compile(" +[^ ]*" if any("\n" in p for p in symbol) else " *[^ \n]+| +|\n")
        surface = [b""] * n
        for i in normal:
            surface[i] = pieces[i].replace(SPACE, " ").encode()
        surface[self.unknown] = UNKNOWN_TEXT
        if self.has_bytes:
            for b, i in enumerate(self.byte_ids):
                surface[i] = bytes([b])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.length = np.array([len(s) for s in surface], np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.is_byte = np.zeros(n, bool)
        if self.has_bytes:
            self.is_byte[self.byte_ids] = True
        self.spaced = np.array([s[:1] == b" " for s in surface]) & ~self.is_byte
        self.spaced[self.unknown] = False
        self.memory: dict[str, bytes] = {}

    # --- encoding -------------------------------------------------------------------------------

    def words_of(self, text: str) -> list[str]:
        """Parts no piece reaches across; each but those after a line break begins with its spaces."""
        return self.pattern.findall(" " + text.replace(SPACE, " ")) if text else []

    def _ranks_at(self, sym: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of the pairs that begin at positions `at`."""
        rank, made = np.full(len(at), _NONE, np.int32), np.zeros(len(at), np.int64)
        a, b = sym[at], sym[at + 1]
        near = np.flatnonzero((owner[at] == owner[at + 1]) & (a < self.stride) & (b < self.stride))
        key = a[near] * self.stride + b[near]
        spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[spot] == key
        rank[near[known]] = self.ranks[spot[known]]
        made[near[known]] = self.made[spot[known]]
        return rank, made

    def merge_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, all words merged in common rounds."""
        codes = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
        place = np.minimum(np.searchsorted(self.characters, codes), len(self.characters) - 1)
        sym = np.where(self.characters[place] == codes, self.character_symbols[place], self.stride + codes)
        rank, made = np.full(len(sym), _NONE, np.int32), np.zeros(len(sym), np.int64)
        if len(sym):
            rank[:-1], made[:-1] = self._ranks_at(sym, owner, np.arange(len(sym) - 1))
        done_sym, done_owner = [], []
        while len(sym):
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.r_[heads, len(sym)])
            open_words = least != _NONE
            if not open_words.all():
                live = np.repeat(open_words, sizes)
                done_sym.append(sym[~live])
                done_owner.append(owner[~live])
                sym, owner, rank, made = sym[live], owner[live], rank[live], made[live]
                least, sizes = least[open_words], sizes[open_words]
            if not len(sym):
                break
            chosen = np.flatnonzero(rank == np.repeat(least, sizes))
            first = np.r_[True, owner[chosen[1:]] != owner[chosen[:-1]]]
            # of overlapping equal pairs every second one goes, counted from the left
            run = np.r_[True, chosen[1:] != chosen[:-1] + 1]
            offset = np.arange(len(chosen)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            chosen = chosen[np.where(self.single[rank[chosen]], first, offset % 2 == 0)]
            sym[chosen] = made[chosen]
            keep = np.ones(len(sym), bool)
            keep[chosen + 1] = False
            sym, owner, rank, made = sym[keep], owner[keep], rank[keep], made[keep]
            moved = chosen - np.arange(len(chosen))
            rank[moved] = _NONE
            # only the pairs on both sides of a merged symbol are new
            for at in (moved[moved < len(sym) - 1], moved[moved > 0] - 1):
                rank[at], made[at] = self._ranks_at(sym, owner, at)
        if not done_sym:
            return [b""] * len(words)
        sym, owner = np.concatenate(done_sym), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        sym, owner = self.spell_out(sym[order], owner[order])
        raw = sym.astype("<u4").tobytes()
        cuts = (np.searchsorted(owner, np.arange(len(words) + 1)) * 4).tolist()
        return [raw[i:j] for i, j in zip(cuts, cuts[1:])]

    def spell_out(self, sym: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters outside the vocabulary as byte pieces, or as one unknown id per run without those."""
        foreign = np.flatnonzero(sym >= self.n)
        if not len(foreign):
            return sym, owner
        names = {v: int(c) for c, v in zip(self.characters, self.character_symbols) if v >= self.n}
        if not self.has_bytes:
            sym = sym.copy()
            sym[foreign] = self.unknown
            keep = np.ones(len(sym), bool)
            keep[1:] = (sym[1:] != self.unknown) | (sym[:-1] != self.unknown) | (owner[1:] != owner[:-1])
            return sym[keep], owner[keep]
        spelled = [chr(names.get(int(s), int(s) - self.stride)).encode() for s in sym[foreign]]
        sizes = np.array([len(b) for b in spelled])
        copies = np.ones(len(sym), np.int64)
        copies[foreign] = sizes
        at = (np.cumsum(copies) - copies)[foreign]
        sym, owner = np.repeat(sym, copies), np.repeat(owner, copies)
        sym[np.repeat(at, sizes) + within(sizes)] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        return sym, owner

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, begin and end included, as little-endian unsigned 32-bit integers."""
        cut = [self.words_of(t) for t in texts]
        new = list(set().union(*cut).difference(self.memory)) if cut else []
        if len(self.memory) + len(new) > REMEMBERED:
            self.memory = {}
            new = list(set().union(*cut))
        if new:
            self.memory.update(zip(new, self.merge_words(new)))
        get = self.memory.__getitem__
        begin, end = np.uint32(self.bos).tobytes(), np.uint32(self.eos).tobytes()
        return [b"".join([begin, *map(get, words), end]) for words in cut]

    # --- decoding -------------------------------------------------------------------------------

    def decode(self, ids: list[bytes]) -> list[str]:
        """Text of each id list: surfaces joined, the first piece without its leading space."""
        counts = np.array([len(b) // 4 for b in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        doc = np.repeat(np.arange(len(ids)), counts)
        length, at = self.length[flat], self.at[flat].copy()
        shown = np.flatnonzero(length > 0)
        opening = shown[np.r_[True, doc[shown[1:]] != doc[shown[:-1]]]] if len(shown) else shown
        opening = opening[self.spaced[flat[opening]]]
        length[opening] -= 1
        at[opening] += 1
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total) + np.repeat(at - (ends - length), length)
        data = self.surface[source].tobytes()
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        # marks inside a text part the bytes beside them
        inner = np.flatnonzero(self.length[flat] == 0)
        inner = inner[(inner > 0) & (inner < len(flat) - 1)]
        inner = inner[self.is_byte[flat[inner - 1]] & (doc[inner - 1] == doc[inner]) & (doc[inner + 1] == doc[inner])]
        split = set(doc[inner].tolist())
        out = []
        for i in range(len(ids)):
            raw = data[bounds[i]:bounds[i + 1]]
            try:
                if i in split:
                    raise UnicodeDecodeError("utf-8", raw, 0, 1, "bytes on both sides of a mark")
                out.append(raw.decode())
            except UnicodeDecodeError:
                out.append(self._decode_broken(np.frombuffer(ids[i], "<u4").astype(np.int64)))
        return out

    def _decode_broken(self, ids: np.ndarray) -> str:
        """Ids whose byte pieces are not UTF-8: each byte that fits nowhere becomes U+FFFD."""
        parts, run, text = [], b"", False
        for i in [*ids.tolist(), -1]:
            if i >= 0 and self.is_byte[i]:
                run += self.surface[self.at[i]:self.at[i] + 1].tobytes()
                continue
            while run:
                size = next((k for k in range(1, 5) if _valid(run[:k])), 0)
                parts.append(run[:size].decode() if size else "�")
                run, text = run[max(size, 1):], True
            if i >= 0 and self.length[i]:
                s = self.surface[self.at[i]:self.at[i] + self.length[i]].tobytes().decode()
                parts.append(s[1:] if not text and self.spaced[i] else s)
                text = True
        return "".join(parts)


def _valid(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def public_model() -> str:
    """Vocabulary file of the registered queries; it is installed beside its package on every node."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_ids(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (array), same: whether decoding the ids gives the text back. Rows as in encode_decode."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(model_path)
        for batch in batches:
            for i, j, _, _ in slices(batch.column(1)):
                texts = batch.column(1).slice(i, j - i).to_pylist()
                ids = model.encode(texts)
                same = [a == b for a, b in zip(model.decode(ids), texts)]
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), lists(flat, np.array([len(x) // 4 for x in ids])), pa.array(same, pa.bool_())],
                    ["doc_id", "ids", "same"])

    return id_and_text(docs).mapInArrow(run, "doc_id bigint, ids array<int>, same boolean")


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit, begin and end included), decoded.

    Null and empty texts give the begin and end ids and an empty text. Every row gives one row, also
    repeated ones; other columns are ignored; an empty table gives no rows. One pass, no shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(model_path)
        for batch in batches:
            for i, j, _, _ in slices(batch.column(1)):
                ids = model.encode(batch.column(1).slice(i, j - i).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(ids, pa.binary()), pa.array(model.decode(ids), pa.string())],
                    ["doc_id", "ids", "decoded"])

    return id_and_text(docs).mapInArrow(run, "doc_id bigint, ids binary, decoded string")
