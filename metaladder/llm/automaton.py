"""Suffix automata of reference shards: the bounded form of substring removal.

A given reference (a benchmark, a licence collection) is cut into shards of at most
``SHARD_WORDS`` words. Each shard's suffix automaton is built once and broadcast; documents
stream through all of them for matching statistics, the length of the longest passage that
ends at each word and occurs in the reference. Words in matches of at least ``length`` words
go. The reference is bounded by ``MAX_WORDS``; larger ones are refused, and the whole corpus
against itself is ``substring_dedup``, for there every shard would meet every document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from . import textops as T

LENGTH, SHARD_WORDS, MAX_WORDS = 20, 200_000, 2_000_000


class Automaton:
    """Suffix automaton of several word sequences; no match runs from one into the next."""

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.long = [-1], [0]
        for words in sequences:
            last = 0
            for w in words:
                last = self._extend(last, w)

    def _extend(self, last: int, w: int) -> int:
        if (there := self.next[last].get(w)) is not None:
            return there if self.long[there] == self.long[last] + 1 else self._split(last, there, w)
        new = self._state(self.long[last] + 1, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.long[q] == self.long[p] + 1 else self._split(p, q, w)
        return new

    def _state(self, long: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.long.append(long)
        return len(self.long) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """The shorter half of state q, reached from p by w."""
        half = self._state(self.long[p] + 1, dict(self.next[q]))
        self.link[half], self.link[q] = self.link[q], half
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = half
            p = self.link[p]
        return half

    def statistics(self, words: Sequence[int]) -> list[int]:
        """Length of the longest match that ends at each word."""
        state, size, out = 0, 0, []
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.long[state]
            if w in self.next[state]:
                state, size = self.next[state][w], size + 1
            else:
                size = 0
            out.append(size)
        return out


def covered(statistics: Sequence[int], length: int) -> np.ndarray:
    """Which words lie in a match of at least ``length`` words."""
    size = np.array(statistics, np.int64)
    delta = np.zeros(len(size) + 1, np.int64)
    end = np.flatnonzero(size >= length)
    np.add.at(delta, end - size[end] + 1, 1)
    np.add.at(delta, end + 1, -1)
    return np.cumsum(delta)[:-1] > 0


def shards(reference: DataFrame, most: int = MAX_WORDS, size: int = SHARD_WORDS) -> list[list[list[int]]]:
    """The reference's texts as hashed word sequences in shards; refused beyond ``most`` words."""
    words = reference.agg(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    if words > most:
        raise ValueError(f"a reference of {words} words is too large to broadcast; {most} are allowed")
    out, held = [[]], 0
    for r in reference.filter("text is not null").select("text").distinct().orderBy("text").collect():
        raw = np.frombuffer(r.text.encode(), np.uint8)
        sequence = T.Words(raw, np.array([0, len(raw)])).hash.tolist()
        if held and held + len(sequence) > size:
            out.append([])
            held = 0
        out[-1].append(sequence)
        held += len(sequence)
    return out


def remove_reference(docs: DataFrame, reference: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` of ``docs`` without passages of ``reference`` (text).

    Null, empty and blank texts have no words. Rows without an id are left out, repeated rows
    are each returned, other columns are ignored. An empty reference removes nothing.
    """
    given = docs.sparkSession.sparkContext.broadcast([Automaton(s) for s in shards(reference)])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in T.slices(whole, "text"):
                raw, at = T.buffers(b.column("text"))
                words = T.Words(raw, at)
                data, rows = raw.tobytes(), []
                for i, doc_id in enumerate(b.column("doc_id").to_pylist()):
                    lo, hi = words.first[i], words.first[i + 1]
                    gone = np.zeros(hi - lo, bool)
                    for a in given.value:
                        gone |= covered(a.statistics(words.hash[lo:hi].tolist()), length)
                    keep = lo + np.flatnonzero(~gone)
                    rows.append((doc_id, hi - lo, int(gone.sum()), b" ".join([data[s:e] for s, e in zip(words.start[keep], words.end[keep])]).decode()))
                yield T.columns(schema, **dict(zip(schema.names, map(list, zip(*rows)))))

    return storage.pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")
