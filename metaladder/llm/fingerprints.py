"""Document fingerprints: MinHash of many universal hash permutations over word shingles.

Every permutation is (a * x + b) modulo the prime 2**31 - 1, taken for all shingles of a run
of texts at once; the least value of each, cut to 16 bits, makes the fingerprint. The share
of equal components estimates the Jaccard similarity of two shingle sets.

``similar`` finds near pairs over a whole table by joining bands of components in Spark and
verifies every candidate on the full shingle sets; ``with_classes`` adds the classes they make.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_dedup, storage
from . import textops as T
from .neighbours import ranged

PERMUTATIONS, SHINGLE, ROWS = 64, 5, 3
PRIME = np.uint64((1 << 31) - 1)
EMPTY = np.uint16(0xFFFF)

OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
OUT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (1 .. p-1) and offsets (0 .. p-1) of n universal hash functions."""
    return T.seeded(n, 0xF1A6) % (PRIME - np.uint64(1)) + np.uint64(1), T.seeded(n, 0xF1B7) % PRIME


def minhash(row: np.ndarray, value: np.ndarray, n: int, count: int = PERMUTATIONS) -> np.ndarray:
    """(n, count) 16-bit fingerprints of sets given as (row, hash) pairs ordered by row."""
    out = np.full((n, count), EMPTY, np.uint16)
    if not len(row):
        return out
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    x = value % PRIME
    a, b = permutations(count)
    for j in range(count):
        h = x * a[j]
        h += b[j]
        h = (h & PRIME) + (h >> np.uint64(31))  # modulo 2**31 - 1, up to one subtraction
        h = np.where(h >= PRIME, h - PRIME, h)
        out[row[begin], j] = (np.minimum.reduceat(h, begin) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def of_texts(raw: np.ndarray, at: np.ndarray, count: int = PERMUTATIONS) -> np.ndarray:
    """Fingerprints of a run of texts."""
    row, value = T.shingle_sets(T.Words(raw, at, lower=True), SHINGLE)
    return minhash(row, value, len(at) - 1, count)


def as_text(prints: np.ndarray) -> list[str]:
    """Lower-case hex, four digits for each component."""
    return [p.astype(">u2").tobytes().hex() for p in prints]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal components."""
    return (a == b).mean(axis=1)


def _of_strings(texts: list[str]) -> np.ndarray:
    raw = [t.encode() for t in texts]
    return of_texts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))


def edited(text: str, following: str) -> str:
    """The text with its last quarter (rounded down) replaced by the start of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, tail, doc_id); each but the copies meets the row after it."""
    held: tuple | None = None  # the last row, its range and fingerprint, waiting for its successor

    for whole in batches:
        for b in T.slices(whole, "text"):
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            ranges, tails = b.column("range").to_pylist(), b.column("tail").to_pylist()
            prints = _of_strings(texts)
            if held is not None:
                ids, texts, ranges, tails = [held[0], *ids], [held[1], *texts], [held[2], *ranges], [held[3], *tails]
                prints = np.concatenate([held[4][None], prints])
            now = [i for i in range(len(ids) - 1) if not tails[i]]
            if any(ranges[i] != ranges[i + 1] for i in now):
                raise ValueError("a range without the first row of the next one")
            if now:
                changed = [edited(texts[i], texts[i + 1]) for i in now]
                other = _of_strings(changed)
                mine = prints[now]
                yield T.columns(OUT, doc_id=[ids[i] for i in now], n_chars=[len(texts[i]) for i in now], edited_sha256=[hashlib.sha256(t.encode()).hexdigest() for t in changed], fingerprint=as_text(mine), edited_fingerprint=as_text(other), near_edited=likeness(mine, other), near_next=likeness(mine, prints[np.array(now) + 1]))
            held = (ids[-1], texts[-1], ranges[-1], tails[-1], prints[-1])


def with_neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    ``docs`` has doc_id and text; a null text counts as empty. The next document is the one
    with the next larger id, after the last the first; a table of one row is its own next.
    Rows that repeat an id follow each other in the order of their texts, and every row is
    returned. Two texts without words have equal fingerprints (all components empty) and
    likeness 1. An empty table gives an empty result. Other columns are ignored. Rows without
    an id are left out. A text is held whole in one task, however long.
    """
    texts = storage.pick(docs, "doc_id", "text").fillna("", ["text"])
    return ranged(texts).select("doc_id", "text", "range", "tail").mapInArrow(_pairs, OUT_DDL)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in T.slices(whole, "text"):
            row, value = T.shingle_sets(T.Words(*T.buffers(b.column("text")), lower=True), SHINGLE)
            sums = near_dedup.set_sums(row, value, b.num_rows)
            keys = near_dedup.band_keys(minhash(row, value, b.num_rows).astype(np.uint64), ROWS)
            used = sums["n_shingles"] > 0
            yield T.columns(near_dedup.SIGNED, doc_id=b.column("doc_id"), **sums, bands=T.lists(keys[used].reshape(-1).view(np.int64), np.concatenate([[0], np.cumsum(used)]) * keys.shape[1], pa.int64()))


def _linked(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links ``a, b``, components ``node, component`` of representatives, members ``doc_id, rep``)."""
    base = storage.workspace(docs.sparkSession, "similar")
    texts = storage.pick(docs, "doc_id", "text")
    banded = storage.materialise(texts.mapInArrow(_prints, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"), base, "banded")
    members, several, buckets = near_dedup.grouped(banded, base)
    links, found = near_dedup.linked(texts, buckets, base, SHINGLE, percent, several)
    copies = members.filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = storage.materialise(links.unionByName(copies).distinct(), base, "similar", heavy=True)
    storage.drop(docs.sparkSession, f"{base}/banded", f"{base}/classes")
    return links, found, members


def similar(docs: DataFrame, *, percent: int = near_dedup.PERCENT) -> DataFrame:
    """``a, b`` with a < b: verified near pairs, enough of them to connect every class.

    Documents of one shingle set are linked with the smallest id among them, and these
    representatives meet in bands: members of a bucket (a band of ``ROWS`` components) meet its
    smallest and largest id, and those of buckets that still hold several classes meet in an
    exact join; a pair is kept if the Jaccard similarity of its full shingle sets is at least
    ``percent`` / 100. A pair at 0.75 shares none of the 21 bands with probability 1e-5. Texts
    without words have no partner. Rows that repeat an id count as one document.
    """
    return _linked(docs, percent)[0]


def with_classes(docs: DataFrame, *, percent: int = near_dedup.PERCENT) -> DataFrame:
    """``with_neighbours`` plus class_id, the smallest id of the near pairs' component, and
    n_links, the pairs of ``similar`` the document is in; its own id and 0 without a partner.
    Rows that repeat an id count as one document here."""
    links, found, members = _linked(docs, percent)
    degree = links.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_links"))
    named = members.join(found, members.rep == found.node, "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("class_id"))
    classes = named.join(degree, "doc_id", "left")
    return with_neighbours(docs).join(classes.hint("merge"), "doc_id", "left").withColumns({"class_id": F.coalesce("class_id", "doc_id"), "n_links": F.coalesce("n_links", F.lit(0))})
