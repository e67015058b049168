"""Near-duplicate documents by one-permutation MinHash with optimal densification.

1. One hash of every shingle fills ``bins`` minima (one permutation); an empty bin copies
   the bin that a 2-universal sequence, the same for all documents, finds first non-empty
   (optimal densification, Shrivastava 2017). ``rows`` bins make a band.
2. Documents with equal shingle sets are one class with the smallest id as representative.
3. Representatives that share a bucket (band and its bins) are tied to two hubs of it, the
   smallest and the largest: stars, so pairs grow with the bucket's size, not its square.
4. Every candidate is confirmed on the full sets, and confirmed links are closed to components.
5. Members of buckets that still hold several components meet in an exact join: two sets that
   are near share one of their rarest shingles (a prefix filter with positions), so every link
   between components that any bucket holds is found. What it confirms is joined to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import storage
from . import textops as T
from .graph import connected_components

SHINGLE, PERCENT, BINS, ROWS, FILTER_BITS = 5, 75, 128, 4, 1 << 25
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def densify(values: np.ndarray, seed: int = 0xD05E) -> np.ndarray:
    """Fill empty bins of an (n, bins) table; rows without any value stay empty."""
    n, bins = values.shape
    full = values != EMPTY
    out, open_ = values.copy(), ~full & full.any(axis=1, keepdims=True)
    turn = 0
    while open_.any():
        pick = (T.seeded(bins, seed + 7919 * turn) % np.uint64(bins)).astype(np.int64)
        ready = open_ & full[:, pick]
        out = np.where(ready, values[:, pick], out)
        open_ &= ~ready
        turn += 1
    return out


def signatures(row: np.ndarray, value: np.ndarray, n: int, bins: int = BINS) -> np.ndarray:
    """One-permutation signature of each of n sets given as (row, hash) pairs."""
    table = np.full(n * bins, EMPTY, np.uint64)
    mixed = T.mix(value ^ np.uint64(0xA5A5F00DCAFEBEEF))
    np.minimum.at(table, row * bins + (mixed % np.uint64(bins)).astype(np.int64), mixed // np.uint64(bins))
    return densify(table.reshape(n, bins))


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(n, bands) bucket keys; the band's number is part of the key."""
    n, bins = signature.shape
    bands = bins // rows
    key = np.broadcast_to(T.seeded(bands, 0xBA2D), (n, bands)).copy()
    for j in range(rows):
        key = T.mix(key * T.GRAM + signature[:, j::rows][:, :bands])
    return key


SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])
SETS = pa.schema([("id", pa.int64()), ("items", pa.binary())])
ITEMS = pa.schema([("id", pa.int64()), ("comp", pa.int64()), ("size", pa.int64()), ("item", pa.int64())])


def _signed(shingle: int, bins: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in T.slices(whole, "text"):
                n = b.num_rows
                row, value = T.shingle_sets(T.Words(*T.buffers(b.column("text")), lower=True), shingle)
                sums = set_sums(row, value, n)
                key = band_keys(signatures(row, value, n, bins), rows)
                used = sums["n_shingles"] > 0
                yield T.columns(SIGNED, doc_id=b.column("doc_id"), **sums, bands=T.lists(key[used].reshape(-1).view(np.int64), np.concatenate([[0], np.cumsum(used)]) * key.shape[1], pa.int64()))

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in T.slices(whole, "text"):
                row, value = T.shingle_sets(T.Words(*T.buffers(b.column("text")), lower=True), shingle)
                yield T.columns(SETS, id=b.column("id"), items=T.binaries(value.view(np.uint8), 8 * np.searchsorted(row, np.arange(b.num_rows + 1))))

    return run


def _items(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in T.slices(whole, "text"):
                row, value = T.shingle_sets(T.Words(*T.buffers(b.column("text")), lower=True), shingle)
                size = np.bincount(row, minlength=b.num_rows)
                ids, comp = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "comp"))
                yield T.columns(ITEMS, id=ids[row], comp=comp[row], size=size[row], item=value.view(np.int64))

    return run


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = np.zeros(t.num_rows, bool)
            for i, (x, y) in enumerate(zip(t.column("items_a"), t.column("items_b"))):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)):
                    both = common(p, q)
                    keep[i] = 100 * both >= percent * (len(p) + len(q) - both)
            yield t.select(["a", "b"]).filter(pa.array(keep))

    return run


def narrowed(texts: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows of ``texts`` whose id is in ``ids`` (one column, id), and a few others, without a shuffle.

    A Bloom filter of ``FILTER_BITS`` bits with one hash, as a table of at most ``FILTER_BITS
    / 64`` rows, is broadcast, whatever the number of ids. An exact join follows it.
    """
    slot = lambda c: F.pmod(F.xxhash64(F.lit(0x1D5), c), F.lit(FILTER_BITS))
    bit = lambda c: F.expr(f"shiftleft(1L, cast({c} % 64 as int))")
    words = ids.select(slot("id").alias("s")).select((F.col("s") / 64).cast("long").alias("nd_word"), bit("s").alias("b")).groupBy("nd_word").agg(F.bit_or("b").alias("nd_bits"))
    marked = texts.withColumn("nd_slot", slot(column)).withColumn("nd_word", (F.col("nd_slot") / 64).cast("long"))
    return marked.join(F.broadcast(words), "nd_word").filter(F.col("nd_bits").bitwiseAND(bit("nd_slot")) != 0).select(*texts.columns)


def shared_buckets(buckets: DataFrame, base: str) -> DataFrame:
    """``doc_id, bucket, low, high`` of buckets with two members or more; low and high are their hubs."""
    hubs = storage.materialise(buckets.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high"), base, "hubs", heavy=True)
    return storage.materialise(buckets.join(hubs, "bucket").select("doc_id", "bucket", "low", "high"), base, "shared", heavy=True)


def stars(shared: DataFrame, base: str) -> DataFrame:
    """``a, b`` (a < b): every member of a bucket with the bucket's smallest and largest id."""
    tied = shared.select("doc_id", F.explode(F.array("low", "high")).alias("hub")).filter("doc_id <> hub")
    return storage.materialise(tied.select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct(), base, "pairs")


def unsettled(shared: DataFrame, found: DataFrame, base: str) -> DataFrame:
    """``doc_id, comp``: members of buckets that hold several components, each once."""
    named = shared.select("doc_id", "bucket").join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("doc_id", "bucket", F.coalesce("component", "doc_id").alias("comp"))
    named = storage.materialise(named, base, "named")
    mixed = named.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("bucket")
    return storage.materialise(named.join(mixed, "bucket", "left_semi").select("doc_id", "comp").distinct(), base, "unsettled")


def across(texts: DataFrame, members: DataFrame, base: str, shingle: int, percent: int) -> DataFrame:
    """``a, b`` (a < b): among ``members``, every near pair of two components, and some others.

    Shingles are ordered by the number of members that hold them. Near sets of sizes x and y
    have at least ``percent * (x + y) / (100 + percent)`` shingles in common, all of them from
    the first common one on, so that one is among the ``x - 2 * percent * x / (100 + percent) + 1``
    first of the smaller set and the ``y - percent * y / 100 + 1`` first of the larger. What one
    component alone holds comes first and can join nothing. Shingles meet in a join that
    adaptive execution can split, without pairs inside the component that holds one most.
    """
    near_by = narrowed(texts, members.select(F.col("doc_id").alias("id")))
    wanted = near_by.join(members.hint("merge"), "doc_id").select("doc_id", "comp", "text").distinct()
    items = storage.materialise(wanted.mapInArrow(_items(shingle), "id long, comp long, size long, item long").distinct(), base, "items", heavy=True)
    open_ = items.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("item", "n")
    rare = Window.partitionBy("id").orderBy("n", "item")
    held = items.join(open_.hint("merge"), "item").withColumns({"k": F.row_number().over(rare), "open": F.count(F.lit(1)).over(Window.partitionBy("id"))})
    # ``left``: how many of the set's shingles there are from this one on.
    held = held.select("id", "comp", "size", "item", (F.col("open") - F.col("k") + 1).alias("left")).filter(f"100 * left >= {percent} * size")
    held = storage.materialise(held, base, "held")
    most = held.groupBy("item", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("item").agg(F.max(F.struct("n", "comp")).alias("m"), F.count(F.lit(1)).alias("comps"))
    posted = storage.materialise(held.join(most.filter("comps > 1").select("item", F.col("m.comp").alias("top")).hint("merge"), "item"), base, "posted")
    few = posted.filter(f"{100 + percent} * left >= {2 * percent} * size")
    names = [F.col(c).alias(f"{c}_b") for c in ("id", "comp", "size", "left")]
    near = f"comp <> comp_b and (size < size_b or size = size_b and id < id_b) and {100 + percent} * least(left, left_b) >= {percent} * (size + size_b)"
    met = [x.join(y.select("item", *names).hint("merge"), "item").filter(near) for x, y in ((few.filter("comp <> top"), posted), (few.filter("comp = top"), posted.filter("comp <> top")))]
    pairs = met[0].union(met[1]).select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b")).distinct()
    pairs = storage.materialise(pairs, base, "pairs")
    storage.drop(texts.sparkSession, *(f"{base}/{x}" for x in ("items", "held", "posted")))
    return pairs


def confirmed(texts: DataFrame, pairs: DataFrame, base: str, shingle: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are near enough; only candidates' texts are moved."""
    # Merge joins at every size: what is small here grows with the corpus.
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # An inner join, for a semi join would be pushed below the filter.
    wanted = narrowed(texts, ends).withColumnRenamed("doc_id", "id").join(ends.hint("merge"), "id")
    sets = storage.materialise(wanted.mapInArrow(_sets(shingle), "id long, items binary").distinct(), base, "sets", heavy=True)
    sets_a, sets_b = (sets.select(F.col("id").alias(x), F.col("items").alias(f"items_{x}")).hint("merge") for x in "ab")
    met = pairs.join(sets_b, "b").join(sets_a, "a")
    links = storage.materialise(met.select("a", "b", "items_a", "items_b").mapInArrow(_confirm(percent), "a long, b long").distinct(), base, "links", heavy=True)
    storage.drop(texts.sparkSession, f"{base}/sets")
    return links


def linked(texts: DataFrame, buckets: DataFrame, base: str, shingle: int, percent: int, given: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Confirmed links ``a, b``, and components ``node, component``, of members that share a bucket (doc_id, bucket).

    All links between members of one bucket are in a component; not every one is listed.
    ``given`` links (a, b) count as confirmed.
    """
    shared = shared_buckets(buckets, base)
    links = confirmed(texts, stars(shared, base), base, shingle, percent)
    if given is not None:
        links = storage.materialise(links.union(given.select("a", "b")), base, "all-links")
    found = storage.materialise(connected_components(links, base), base, "components")
    again = f"{base}/again"
    open_ = unsettled(shared, found, again)
    storage.drop(texts.sparkSession, f"{base}/shared", f"{base}/hubs", f"{base}/pairs", f"{again}/named")
    if open_.isEmpty():
        return links, found
    more = confirmed(texts, across(texts, open_, again, shingle, percent), again, shingle, percent)
    if more.isEmpty():
        return links, found
    # Components found so far come back as stars, which close at once.
    settled = found.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return links.union(more), storage.materialise(connected_components(settled.union(more), again), again, "components")


def set_sums(row: np.ndarray, value: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """n_shingles, set_a, set_b of n sets given as (row, hash) pairs: two sums that tell sets apart."""
    at = np.searchsorted(row, np.arange(n + 1))
    out = {"n_shingles": np.diff(at)}
    for name, salt in (("set_a", 0x1), ("set_b", 0x2F0E)):
        total = np.concatenate([[np.uint64(0)], np.cumsum(T.mix(value + np.uint64(salt)))])
        out[name] = (total[at[1:]] - total[at[:-1]]).view(np.int64)
    return out


def grouped(signed: DataFrame, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What equal sets make of ``signed`` (doc_id, n_shingles, set_a, set_b, bands).

    (``doc_id, rep``: every document with shingles and the smallest id of its set;
    ``a, b``: links between the representatives of an id that has several texts, for they
    belong together; ``doc_id, bucket`` of the representatives).
    """
    key = ["set_a", "set_b", "n_shingles"]
    full = signed.filter("n_shingles > 0")
    classes = storage.materialise(full.groupBy(*key).agg(F.min("doc_id").alias("rep")), base, "classes")
    members = storage.materialise(full.select("doc_id", *key).join(classes, key).select("doc_id", "rep").distinct(), base, "members")
    several = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last"), F.collect_set("rep").alias("reps")).filter("a < last").select("a", F.explode("reps").alias("b")).filter("a < b").distinct()
    heads = full.join(members.filter("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi")
    return members, several, heads.select("doc_id", F.explode("bands").alias("bucket"))


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (doc_id, text).

    Words are lower-cased (A-Z) and split at ASCII white space. Linked are documents whose
    sets satisfy ``100 * |A and B| >= percent * |A or B|``. A null or empty text, or one of
    white space alone, has no shingles and is linked with nothing. Rows with one id are one
    document, linked with whatever any of their texts is near to; each row is returned with
    its own n_shingles. Ties need no rule: a component's id is its smallest id. Other columns
    of ``docs`` are ignored. Rows without an id are left out, an empty table gives an empty
    result, and a text is held whole in one task, however long.

    A pair at the threshold shares none of the ``bins / rows`` bands with probability
    ``(1 - 0.75 ** rows) ** (bins / rows)``, 5e-6 at the defaults.
    """
    base = storage.workspace(docs.sparkSession, "near")
    texts = storage.pick(docs, "doc_id", "text")
    signed = storage.materialise(texts.mapInArrow(_signed(shingle, bins, rows), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"), base, "signed")
    members, several, buckets = grouped(signed, base)
    _, found = linked(texts, buckets, base, shingle, percent, several)
    named = members.join(found, members.rep == found.node, "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    return signed.select("doc_id", "n_shingles").join(named, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), (F.coalesce("component_id", "doc_id") == F.col("doc_id")).alias("kept")
    )
