"""Removing passages that already stand earlier in the corpus.

A window is ``length`` consecutive words of one document. A word goes if a window covers it
whose words also start earlier (smaller id, or same document and earlier start). The result
is exact up to collisions of 64-bit window hashes, and a passage may occur any number of
times:

1. A document whose whole text occurs earlier, by a 128-bit digest, loses all its words if
   it has a window at all, and takes no further part: it is never where something is first.
2. Every window is represented by its least ``GRAM``-word hash (winnowing, Schleimer et al.
   2003): equal windows have equal anchors, and about two positions in
   ``length - GRAM + 2`` are anchors. Only anchors that occur twice can belong to a repeat.
3. The windows over such anchors are hashed whole. Repeats inside a document are settled
   there; across documents the smallest id of each hash stays, the others are hits.
4. Each document meets its hits and drops the covered words.

Suffix automata (``automaton.py``) serve the bounded case, a given reference: see there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from . import textops as T

LENGTH, GRAM, STRETCH = 20, 6, 1 << 22
LOW = np.uint64((1 << 24) - 1)

SKETCHES = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("anchors", pa.list_(pa.int64()))])
WINDOWS = pa.schema([("window", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32())])


def anchors(words: T.Words, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, anchor position) of every window, and the hash of every gram.

    The anchor is the leftmost least hash among the grams inside the window. Its upper 40
    bits decide; positions in the low bits break ties to the left. Positions count within
    stretches of ``STRETCH`` windows, so a run of texts may have any number of words.
    """
    g = T.grams(words.hash, gram)
    m, n = length - gram + 1, len(words.hash) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), g
    least = np.empty(n, np.int64)
    for lo in range(0, n, STRETCH):
        part = g[lo : lo + STRETCH + m - 1]
        run, size = (part & ~LOW) | np.arange(len(part), dtype=np.uint64), 1
        while size * 2 <= m:
            run, size = np.minimum(run[:-size], run[size:]), size * 2
        found = np.minimum(run[: len(part) - m + 1], run[m - size : len(part) - size + 1])
        least[lo : lo + len(found)] = lo + (found & LOW).astype(np.int64)
    at = np.flatnonzero(T.in_one_row(words.row, length))
    return at, least[at], g


def _sketches(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in T.slices(whole, "text"):
                raw, at = T.buffers(b.column("text"))
                words = T.Words(raw, at)
                _, position, g = anchors(words, length, gram)
                position = np.unique(position)
                ends = np.searchsorted(words.row[position], np.arange(b.num_rows + 1))
                data = raw.tobytes()
                digests = [hashlib.blake2b(data[lo:hi], digest_size=16).digest() for lo, hi in zip(at[:-1], at[1:])]
                yield T.columns(SKETCHES, doc_id=b.column("doc_id"), digest=pa.array(digests, pa.binary()), anchors=T.lists(g[position].view(np.int64), ends, pa.int64()))

    return run


def _windows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in T.slices(whole, "text"):
                words = T.Words(*T.buffers(b.column("text")))
                at, position, g = anchors(words, length, gram)
                raw, ends = T.buffers(b.column("seen"))
                seen = raw.view(np.uint64)
                # Anchor hashes of a document are looked up together with its row.
                own = np.repeat(np.arange(b.num_rows, dtype=np.uint64), np.diff(ends) // 8)
                known = np.sort(T.mix(seen + T.mix(own)))
                probe = T.mix(g[position] + T.mix(words.row[at].astype(np.uint64)))
                hit = known[np.minimum(np.searchsorted(known, probe), max(0, len(known) - 1))] == probe if len(known) else np.zeros(len(at), bool)
                at = at[hit]
                value, row = T.grams(words.hash, length)[at], words.row[at]
                order = np.lexsort((at, value, row))
                at, value, row = at[order], value[order], row[order]
                again = np.zeros(len(at), bool)
                again[1:] = (value[1:] == value[:-1]) & (row[1:] == row[:-1])
                ids = b.column("doc_id").to_numpy(zero_copy_only=False)
                yield T.columns(WINDOWS, window=pa.array(value.view(np.int64), mask=again), doc_id=ids[row], start=(at - words.first[row]).astype(np.int32))

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """array<long> to its bytes, sorted."""
    schema = pa.schema([("doc_id", pa.int64()), ("seen", pa.binary())])
    for b in batches:
        values = b.column("seen")
        flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        yield T.columns(schema, doc_id=b.column("doc_id"), seen=T.binaries(flat.view(np.uint8), 8 * at))


KEPT = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string())])


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in T.slices(whole, "text"):
                raw, at = T.buffers(b.column("text"))
                words = T.Words(raw, at)
                starts = b.column("starts")
                flat = starts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                lens = starts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                first = words.first[np.repeat(np.arange(b.num_rows), lens)] + flat
                delta = np.zeros(len(words.hash) + 1, np.int64)
                np.add.at(delta, first, 1)
                np.add.at(delta, first + length, -1)
                gone = np.cumsum(delta)[:-1] > 0
                copy = b.column("copy").fill_null(False).to_numpy(zero_copy_only=False) & (np.diff(words.first) >= length)
                gone |= copy[words.row]
                removed = np.concatenate([[0], np.cumsum(gone)])
                keep = np.flatnonzero(~gone)
                # Kept words joined by one blank: copy each word with the byte after it.
                size = words.end[keep] - words.start[keep] + 1
                ends = np.cumsum(size)
                out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
                if len(keep):
                    shift = np.repeat(words.start[keep] - (ends - size), size)
                    source = np.arange(len(out)) + shift
                    letter = np.ones(len(out), bool)
                    letter[ends - 1] = False
                    out[letter] = raw[source[letter]]
                data, texts, sums = out.tobytes(), [], []
                edge = np.concatenate([[0], ends])[np.searchsorted(words.row[keep], np.arange(b.num_rows + 1))]
                for lo, hi in zip(edge[:-1], edge[1:]):
                    texts.append(data[lo : max(lo, hi - 1)])
                    sums.append(hashlib.sha256(texts[-1]).hexdigest())
                yield T.columns(KEPT, doc_id=b.column("doc_id"), text_hash=b.column("text_hash"), n_words=np.diff(words.first), n_removed=removed[words.first[1:]] - removed[words.first[:-1]], kept_text=pa.array(texts, pa.binary()).cast(pa.string()), kept_sha256=sums)

    return run


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, text_hash, n_words, n_removed, kept_text, kept_sha256`` for every row of ``docs``.

    ``text_hash`` is Spark's xxhash64 of the text, to tell rows of one id apart.

    Words are maximal runs of non-white-space, unchanged; ``kept_text`` joins the kept ones
    with one blank. Null, empty and blank texts have no words and an empty kept text; a text
    shorter than a window keeps all its words. Ties need no rule, for (doc_id, start) orders
    all windows; where an id is repeated its rows are read as the same document, so its
    windows do not remove each other. Other columns of ``docs`` are ignored. Rows without an
    id are left out, an empty table gives an empty result, and a text is held whole in one
    task, however many words it has.
    """
    spark = docs.sparkSession
    base = storage.workspace(spark, "repeats")
    texts = storage.pick(docs, "doc_id", "text")
    sketches = storage.materialise(texts.mapInArrow(_sketches(length, gram), "doc_id long, digest binary, anchors array<long>"), base, "sketches", heavy=True)
    groups = sketches.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("first_id < last_id")
    groups = storage.materialise(groups.select("digest", "first_id"), base, "groups")
    copies = storage.materialise(sketches.select("doc_id", "digest").join(groups, "digest").filter("doc_id > first_id").select("doc_id").distinct(), base, "copies")
    found = sketches.select("doc_id", "anchors").join(copies.hint("merge"), "doc_id", "left_anti").select("doc_id", F.explode("anchors").alias("anchor"))
    twice = storage.materialise(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), base, "twice", heavy=True)
    seen = found.join(twice.hint("merge"), "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("seen"))
    seen = storage.materialise(seen.mapInArrow(_pack, "doc_id long, seen binary"), base, "seen", heavy=True)
    storage.drop(spark, f"{base}/sketches", f"{base}/twice", f"{base}/groups")

    windows = texts.join(seen.hint("merge"), "doc_id").mapInArrow(_windows(length, gram), "window long, doc_id long, start int")
    windows = storage.materialise(windows, base, "windows", heavy=True)
    storage.drop(spark, f"{base}/seen")
    across = windows.filter("window is not null")
    first = across.groupBy("window").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("first_id < last_id").select("window", "first_id")
    first = storage.materialise(first, base, "first", heavy=True)
    later = across.join(first.hint("merge"), "window").filter("doc_id > first_id").select("doc_id", "start")
    hits = later.union(windows.filter("window is null").select("doc_id", "start")).groupBy("doc_id").agg(F.collect_set("start").alias("starts"))
    hits = storage.materialise(hits.unionByName(copies.select("doc_id", F.lit(None).cast("array<int>").alias("starts"))).withColumn("hit", F.lit(True)), base, "hits", heavy=True)
    storage.drop(spark, f"{base}/windows", f"{base}/first", f"{base}/copies")
    marked = texts.join(hits.hint("merge"), "doc_id", "left").select("doc_id", F.xxhash64("text").alias("text_hash"), "text", "starts", (F.col("hit") & F.col("starts").isNull()).alias("copy"))
    return marked.mapInArrow(_remove(length), "doc_id long, text_hash long, n_words long, n_removed long, kept_text string, kept_sha256 string")
