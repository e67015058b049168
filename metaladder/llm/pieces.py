"""SentencePiece BPE encoding by suffix-array matching, and decoding.

Encoding of a batch:

1. Its distinct units (maximal stretches that no piece can cross) are concatenated and
   indexed by a suffix array, compared up to the longest piece.
2. Every piece is binary-searched in the array, all pieces at once; the ranges are the
   occurrences, which become edges (start, end, piece).
3. Edges are put in order of their end, longest first, by a counting sort on (end, length).
4. One relaxation over the positions keeps the last token of every prefix.

Relaxation gives byte-pair encoding itself, not a maximum of summed scores: the last token
of a prefix is the longest edge that is compatible with the last token where it begins, and
two tokens are compatible if encoding their joined text gives the two again. For merges by
score with ties to the left there is exactly one such edge at each position, so ids equal
the sentencepiece library's.
"""

from __future__ import annotations

import struct
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import textops as T
from .unit_memory import UnitMemory

SPACE = "\u2581"
NORMAL, UNKNOWN_TYPE, CONTROL, USER, BYTE_TYPE = 1, 2, 3, 4, 6
NONE = np.int32(-1)
#: Units above this many characters are relaxed one position at a time.
LONG = 256
#: Characters indexed at once.
INDEXED = 1 << 19
CACHE_BITS = 21


def fields(data: bytes):
    """(number, value) of the fields of a protocol-buffer message."""

    def varint(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out |= (data[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if data[i - 1] < 128:
                return out, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        elif kind == 5:
            value, i = struct.unpack("<f", data[i : i + 4])[0], i + 4
        elif kind == 1:
            value, i = data[i : i + 8], i + 8
        else:
            raise ValueError("not a model file")
        yield tag >> 3, value


class Model:
    """Pieces of a BPE model with byte fallback and the identity normalizer."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(fields(f.read()))
        read = [dict(fields(v)) for k, v in parts if k == 1]
        self.text = [p.get(1, b"").decode() for p in read]
        self.score = np.array([p.get(2, 0.0) for p in read])
        self.kind = np.array([p.get(3, NORMAL) for p in read])
        trainer = dict(fields(next((v for k, v in parts if k == 2), b"")))
        normalizer = dict(fields(next((v for k, v in parts if k == 3), b"")))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or (self.kind == USER).any():
            raise ValueError("only BPE models with byte fallback and without user-defined pieces are supported")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only the identity normalizer without white-space removal is supported")
        self.prefix = bool(normalizer.get(3, 1))
        self.byte_id = np.full(256, -1)
        for i in np.flatnonzero(self.kind == BYTE_TYPE):
            self.byte_id[int(self.text[i][3:5], 16)] = i
        self._build()

    def _build(self) -> None:
        """Tokens: 0 an unknown character, then single characters, then merges by falling score."""
        normal = [i for i in range(len(self.text)) if self.kind[i] == NORMAL]
        chars = [i for i in normal if len(self.text[i]) == 1]
        merges = sorted((i for i in normal if len(self.text[i]) > 1), key=lambda i: (-self.score[i], i))
        if any(SPACE in self.text[i].lstrip(SPACE) for i in merges):
            raise ValueError("a piece holds a blank after another character")
        extra = sorted({c for i in merges for c in self.text[i]} - {self.text[i] for i in chars})
        order = [*(self.text[i] for i in chars), *extra, *(self.text[i] for i in merges)]
        self.id = np.array([-1, *chars, *[-1] * len(extra), *merges])
        place = {t: k for k, t in enumerate(order, 1)}
        n = len(order) + 1
        self.length = np.array([1, *map(len, order)])
        self.left, self.right = np.arange(n), np.arange(n)
        lookup: dict[tuple[int, int], int] = {}
        for k, t in enumerate(order, 1):
            for j in range(1, len(t)):
                a, b = place.get(t[:j]), place.get(t[j:])
                if a and b:
                    lookup[a, b] = k
        reachable = np.ones(n, bool)
        for k, t in enumerate(order, 1):
            if len(t) > 1:
                now = [place[c] for c in t]
                while len(now) > 1:
                    best = min(((lookup.get((x, y), n), j) for j, (x, y) in enumerate(zip(now, now[1:]))))
                    if best[0] == n:
                        break
                    self.left[k], self.right[k] = now[best[1]], now[best[1] + 1]
                    now[best[1] : best[1] + 2] = [best[0]]
                reachable[k] = now == [k]
        keys = np.array([a * n + b for a, b in lookup], np.int64)
        values = np.array(list(lookup.values()), np.int64)
        sort = np.argsort(keys)
        self.pair_key, self.pair_value, self.n = keys[sort], values[sort], n
        self.lookup = lookup
        self.longest = int(self.length.max())
        # Characters of longer pieces get small codes; 0 stands for all others.
        used = sorted({ord(c) for t in order if len(t) > 1 for c in t})
        self.code_of = np.zeros(max(used, default=0) + 1, np.uint64)
        self.code_of[used] = np.arange(1, len(used) + 1)
        self.bits = max(1, int(len(used)).bit_length())
        self.per_word = 63 // self.bits
        self.char_token = np.zeros(max((ord(t) for t in order if len(t) == 1), default=0) + 1, np.int32)
        for t in order:
            if len(t) == 1:
                self.char_token[ord(t)] = place[t]
        self.many = np.array([k for k, t in enumerate(order, 1) if len(t) > 1 and reachable[k]])
        codes = np.zeros((len(self.many), self.words * self.per_word), np.uint64)
        for row, k in enumerate(self.many):
            t = order[k - 1]
            codes[row, : len(t)] = [self.code_of[ord(c)] for c in t]
        self.low = self._packed(codes)
        full = np.arange(codes.shape[1])[None] >= self.length[self.many][:, None]
        self.high = self._packed(np.where(full, np.uint64((1 << self.bits) - 1), codes))
        # Line ends are cut points of their own where no longer piece holds one.
        self.line_cut = not any("\n" in t for t in order if len(t) > 1)
        self.bytes = [b"" if self.kind[i] in (CONTROL, UNKNOWN_TYPE) else bytes([int(t[3:5], 16)]) if self.kind[i] == BYTE_TYPE else t.replace(SPACE, " ").encode() for i, t in enumerate(self.text)]

    @property
    def words(self) -> int:
        return -(-self.longest // self.per_word)

    def _packed(self, codes: np.ndarray) -> np.ndarray:
        """(rows, words) keys that compare like the rows of character codes."""
        out = np.zeros((len(codes), self.words), np.uint64)
        for j in range(codes.shape[1]):
            w = j // self.per_word
            out[:, w] = (out[:, w] << np.uint64(self.bits)) | codes[:, j]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether encoding the joined text of tokens a and b gives a and b again."""
        out = np.ones(len(a), bool)
        rows, a, b = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), np.int64(1) << 40)
        while len(rows):
            key = a * self.n + b
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            bad = (self.pair_key[at] == key) & (self.pair_value[at] < limit)
            out[rows[bad]] = False
            # Undo the later of the two tokens' last merges; an unsplit one leaves the other.
            right, left = self.right[a], self.left[b]
            first = np.where(right == a, False, np.where(left == b, True, a > b))
            stuck = (right == a) & (left == b)
            limit = np.where(first, a, b + 1)
            a, b = np.where(first, right, a), np.where(first, b, left)
            live = ~bad & ~stuck
            rows, a, b, limit = rows[live], a[live], b[live], limit[live]
        return out


def suffix_array(model: Model, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, keys in that order) of all suffixes, compared over the longest piece."""
    n = len(codes)
    padded = np.concatenate([codes, np.zeros(model.words * model.per_word, np.uint64)])
    keys = np.zeros((model.words, n), np.uint64)
    for w in range(model.words):
        for j in range(w * model.per_word, (w + 1) * model.per_word):
            keys[w] = (keys[w] << np.uint64(model.bits)) | padded[j : j + n]
    order = np.lexsort(keys[::-1])
    return order, keys[:, order]


def bound(keys: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of every row of ``wanted`` at once: the first place whose key is not below
    it (``after``: is above it)."""
    lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), keys.shape[1], np.int64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        at = np.minimum(mid, keys.shape[1] - 1)
        less, same = np.zeros(len(wanted), bool), np.ones(len(wanted), bool)
        for w in range(len(keys)):
            have = keys[w][at]
            less |= same & (have < wanted[:, w])
            same &= have == wanted[:, w]
        right = (less | same) if after else less
        lo, hi = np.where(open_ & right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
    return lo


class Encoder(UnitMemory):
    """Ids of texts under a model."""

    def __init__(self, model: Model):
        self.model = model
        self.cached = np.full(1 << CACHE_BITS, -1, np.int64)
        super().__init__()

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible`` through a direct-mapped cache of earlier answers."""
        key = a.astype(np.int64) * self.model.n + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        held = self.cached[slot]
        out = (held & 1).astype(bool)
        miss = np.flatnonzero(held >> 1 != key)
        if len(miss):
            out[miss] = self.model.compatible(a[miss], b[miss])
            self.cached[slot[miss]] = (key[miss] << 1) | out[miss]
        return out

    def encode_units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts, ids, sizes, lo = units.to_pylist(), [], [], 0
        length = np.array([len(t) for t in texts])
        ends = np.cumsum(length)
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + INDEXED, "right")))
            got, size = self._batch(texts[lo:hi], length[lo:hi])
            ids.append(got)
            sizes.append(size)
            lo = hi
        return np.concatenate(ids), np.concatenate(sizes)

    def _batch(self, texts: list[str], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        model = self.model
        points = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.cumsum(length + 1) - (length + 1)
        codes = np.where(points < len(model.code_of), model.code_of[np.minimum(points, len(model.code_of) - 1)], np.uint64(0))
        codes[begin[1:] - 1] = 0
        n = len(points)
        # Entry [l, e]: the piece of l characters that ends before place e.
        edge = np.full((model.longest + 1, n + 1), NONE, np.int32)
        edge[1, 1:] = np.where(points < len(model.char_token), model.char_token[np.minimum(points, len(model.char_token) - 1)], 0)
        if n:
            order, keys = suffix_array(model, codes)
            low, high = bound(keys, model.low, False), bound(keys, model.high, True)
            found = high - low
            start = order[T.ragged(low, found)]
            size = np.repeat(model.length[model.many], found)
            edge[size, start + size] = np.repeat(model.many, found)
        last = np.full(n + 1, NONE, np.int32)
        long = np.flatnonzero(length > LONG)
        for u in long:
            self._relax_one(edge, last, int(begin[u]), int(length[u]))
        short = np.flatnonzero((length > 0) & (length <= LONG))
        short = short[np.argsort(-length[short], kind="stable")]
        for k in range(1, int(length[short[0]]) + 1 if len(short) else 1):
            short = short[: np.searchsorted(-length[short], -k, "right")]
            end = begin[short] + k
            for size in range(min(k, model.longest), 0, -1):
                piece = edge[size, end]
                some = np.flatnonzero(piece >= 0)
                if not len(some):
                    continue
                if size < k:
                    some = some[self._fits(last[end[some] - size], piece[some])]
                last[end[some]] = piece[some]
                rest = np.ones(len(end), bool)
                rest[some] = False
                end = end[rest]
                if not len(end):
                    break
        return self._traced(points, last, begin, length)

    def _relax_one(self, edge: np.ndarray, last: np.ndarray, begin: int, length: int) -> None:
        memory: dict[tuple[int, int], bool] = {}
        for k in range(1, length + 1):
            column = edge[:, begin + k].tolist()
            for size in range(min(k, self.model.longest), 0, -1):
                piece = column[size]
                if piece < 0:
                    continue
                if size < k:
                    pair = (int(last[begin + k - size]), piece)
                    if pair not in memory:
                        memory[pair] = bool(self._fits(np.array([pair[0]]), np.array([pair[1]]))[0])
                    if not memory[pair]:
                        continue
                last[begin + k] = piece
                break

    def _traced(self, points: np.ndarray, last: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        model = self.model
        ends = np.zeros(len(last), bool)
        low, at = begin[length > 0], (begin + length)[length > 0]
        while len(at):
            ends[at] = True
            at = at - model.length[last[at]]
            low, at = low[at > low], at[at > low]
        at = np.flatnonzero(ends)
        ids = model.id[last[at]]
        unit = np.searchsorted(begin, at, "left") - 1
        count = np.ones(len(at), np.int64)
        if len(odd := np.flatnonzero(ids < 0)):
            # Characters without a piece fall back to their bytes.
            raw = [chr(p).encode() for p in points[at[odd] - 1]]
            count[odd] = [len(r) for r in raw]
            full = np.repeat(ids, count)
            full[np.repeat(ids, count) < 0] = model.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
            ids = full
        return ids, np.bincount(unit, weights=count, minlength=len(length)).astype(np.int64)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets); nulls are empty texts."""
        column = pc.fill_null(column, "").cast(pa.string())
        empty = pc.equal(column, "")
        # A text with NUL characters, which mark the cuts, stays one unit.
        plain = pc.invert(pc.match_substring(column, "\0"))
        marked = pc.replace_substring(column, " ", SPACE)
        if self.model.prefix:
            marked = pc.if_else(empty, "", pc.binary_join_element_wise(SPACE, marked, ""))
        cut = pc.replace_substring_regex(marked, f"([^{SPACE}]){SPACE}", f"\\1\0{SPACE}")
        if self.model.line_cut:
            cut = pc.replace_substring(cut, "\n", "\0\n\0")
        listed = pc.split_pattern(cut, "\0")
        if not pc.all(plain).as_py():
            flags = plain.to_pylist()
            listed = pa.array([x if ok else [t] for x, ok, t in zip(listed.to_pylist(), flags, marked.to_pylist())], pa.list_(pa.string()))
        coded = listed.flatten().dictionary_encode()
        code = self.codes(coded.dictionary)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        size = self.size[code]
        ends = np.concatenate([[0], np.cumsum(size)])
        sizes = pc.list_value_length(listed).to_numpy(zero_copy_only=False)
        return self.pool[T.ragged(self.start[code], size)], ends[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]


def decode(model: Model, ids: np.ndarray, at: np.ndarray) -> list[str]:
    """Texts of runs of ids: pieces joined, marks read as blanks, the added first blank taken off."""
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        raw = b"".join([model.bytes[i] for i in ids[lo:hi].tolist()])
        text = raw.decode(errors="replace")
        out.append(text[1:] if model.prefix and text[:1] == " " else text)
    return out


@cache
def encoder(path: str) -> Encoder:
    """The worker process's encoder for a model file."""
    return Encoder(Model(path))
