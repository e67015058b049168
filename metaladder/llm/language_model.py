"""Scoring texts with a causal self-attention model and corpus-wide word counts.

A word's subword id is its ending, hashed to ``IDS - 1`` ids; id 0 ends a text. The model's
probability of a word is attention's probability of its subword id, given the ids before it,
times the word's smoothed share among the training words of that id,
``(c + 1) / (N_id + V_id + 1)``; words never seen share the last slot.

One pass over the training documents gathers, all of it growing with the corpus: word counts,
bigram counts of ids, and the ids of every document. Attention is trained once on all of
them, in ``ROUNDS`` rounds: a round takes the documents that its hash of their ids deals to
it, in shards of about ``SHARD`` tokens; each shard trains from the network of the round
before, and the shards' parameters are averaged in Spark, weighted by blocks, as exact sums
of fixed-point numbers. Shards depend on the rows alone, not on partitions, and so does the
network. A last pass scores. The counts of the most frequent words, at most ``HEAD`` of
them, are broadcast; all other words meet their counts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention, storage
from . import textops as T

IDS, HEAD, SHARD, ROUNDS = 128, 1 << 20, 1 << 19, 4
#: Ids of one run that a row holds at most; longer documents are dealt in several runs.
RUN = 1 << 16
WORDS, BIGRAMS, RUNS = 0, 1, 2
FLUSH, RATE, FIXED_POINT = 750_000, 6e-3, 1 << 24

GATHERED = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("id", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])
SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("seen", pa.float64()), ("model", pa.float64()), ("rest", pa.list_(pa.int64()))])


def subwords(raw: np.ndarray, words: T.Words) -> np.ndarray:
    """Id of every word from its last three bytes, lower-cased."""
    tail = np.zeros(len(words.hash), np.uint64)
    for j in range(1, 4):
        at = words.end - j
        inside = at >= words.start
        tail = (tail << np.uint64(8)) | np.where(inside, T.LOWER[raw[np.maximum(at, 0)]], 0).astype(np.uint64)
    return (T.mix(tail) % np.uint64(IDS - 1)).astype(np.int64) + 1


def with_ends(words: T.Words, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids with an end after each text, offsets)."""
    n = len(words.first) - 1
    at = words.first + np.arange(n + 1)
    out = np.zeros(at[-1], np.int64)
    out[np.arange(len(ids)) + words.row] = ids
    return out, at


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, one place of each, and their sums."""
    order = np.argsort(key)
    begin = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0])) if len(key) else np.zeros(0, np.int64)
    return key[order][begin], order[begin], np.add.reduceat(n[order], begin) if len(key) else n


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bigrams = np.zeros((IDS + 1) * IDS, np.int64)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size, ends = 0, 0

    def words_of() -> pa.RecordBatch:
        key, ids, n = (np.concatenate(x) for x in zip(*held))
        key, at, n = _summed(key, n)
        return T.columns(GATHERED, kind=np.full(len(key), WORDS, np.int32), key=key, id=ids[at], n=n, data=pa.nulls(len(key), pa.binary()))

    for whole in batches:
        for b in T.slices(whole, "text"):
            raw, at = T.buffers(b.column("text"))
            words = T.Words(raw, at, lower=True)
            ids = subwords(raw, words)
            key, place, n = _summed(words.hash.view(np.int64), np.ones(len(ids), np.int64))
            held.append((key, ids[place], n))
            size, ends = size + len(key), ends + b.num_rows
            runs, edge = with_ends(words, ids)
            inputs, _, _, targets, real = attention.layout(runs, edge, IDS)
            bigrams += np.bincount((inputs * IDS + targets)[real], minlength=len(bigrams))
            parts = -(-np.diff(edge) // RUN)
            row, part = np.repeat(np.arange(b.num_rows), parts), T.ragged(np.zeros(b.num_rows, np.int64), parts)
            cuts = np.append(edge[row] + part * RUN, edge[-1])
            doc_ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            yield T.columns(GATHERED, kind=np.full(len(row), RUNS, np.int32), key=doc_ids[row], id=part, n=np.diff(cuts), data=T.binaries(runs.astype(np.uint8), cuts))
            if size > FLUSH:
                yield words_of()
                held, size = [], 0
    if held:
        yield words_of()
    if ends:
        at = np.flatnonzero(bigrams)
        yield T.columns(GATHERED, kind=np.full(len(at), BIGRAMS, np.int32), key=at, id=np.zeros(len(at)), n=bigrams[at], data=pa.nulls(len(at), pa.binary()))


class Scorer:
    """What scoring needs on every executor; its size is bounded by HEAD and IDS."""

    def __init__(self, network: dict, share: np.ndarray, end: float, end_known: bool, key: np.ndarray, value: np.ndarray, complete: bool):
        #: log10 of the denominators by id, the end's log10(c + 1), whether it was seen.
        self.network, self.share, self.end, self.end_known = network, share, end, end_known
        #: Sorted hashes of frequent words with log10(c + 1); complete: there are no other words.
        self.key, self.value, self.complete = key, value, complete


def _flat(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p) if k not in attention.FIXED])


def _trained(shared, turn: int):
    """Parameters after training on each shard, as sums weighted by blocks; rows come sorted by shard."""

    def one(shard: int, runs: list[bytes]) -> tuple[int, np.ndarray]:
        ids = np.frombuffer(b"".join(runs), np.uint8).astype(np.int64)
        inputs, before, first, targets, real = attention.layout(ids, np.concatenate([[0], np.cumsum([len(x) for x in runs])]), IDS)
        p = attention.train(shared.value, inputs, before, first, targets, real.astype(np.float32), rate=RATE * (1 - turn / ROUNDS), seed=11 + ROUNDS * shard + turn)
        return len(inputs), np.rint(_flat(p).astype(np.float64) * FIXED_POINT).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, runs = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if runs:
                n, p = one(now, runs)
                yield pa.RecordBatch.from_pydict({"blocks": pa.array([n], pa.int64()), "total": pa.array([p], pa.list_(pa.int64()))})

        for b in batches:
            for shard, data in zip(b.column("shard").to_pylist(), b.column("data").to_pylist()):
                if shard != now:
                    yield from close()
                    now, runs = shard, []
                runs.append(data)
        yield from close()

    return run


def _round(gathered: DataFrame, network: dict, tokens: int, turn: int) -> tuple[dict, int]:
    """The network after a round, and the blocks it was trained on."""
    shards = max(1, -(-tokens // (ROUNDS * SHARD)))
    shared = gathered.sparkSession.sparkContext.broadcast(network)
    mine = gathered.filter((F.col("kind") == RUNS) & (F.pmod(F.xxhash64(F.lit(1), "key", "id"), F.lit(ROUNDS)) == turn))
    dealt = mine.select(F.pmod(F.xxhash64(F.lit(2), "key", "id"), F.lit(shards)).cast("int").alias("shard"), "key", "id", "data")
    done = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "key", "id", "data").select("shard", "data").mapInArrow(_trained(shared, turn), "blocks long, total array<long>")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).cast("double").alias(c)
    parts = done.select("blocks", F.posexplode("total").alias("place", "v")).withColumn("v", F.col("v") * F.col("blocks")).groupBy("place").agg(exact("v"), exact("blocks")).orderBy("place").toArrow()
    shared.destroy()
    if not parts.num_rows:
        return network, 0
    blocks = parts.column("blocks")[0].as_py()
    flat, at, new = parts.column("v").to_numpy() / blocks / FIXED_POINT, 0, {k: network[k] for k in attention.FIXED}
    for k in sorted(k for k in network if k not in attention.FIXED):
        size = network[k].size
        new[k] = flat[at : at + size].reshape(network[k].shape).astype(np.float32)
        at += size
    return new, int(blocks)


def _network(gathered: DataFrame, tokens: int) -> dict:
    pairs = gathered.filter(F.col("kind") == BIGRAMS).groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((IDS + 1) * IDS)
    counts[pairs.column("key").to_numpy()] = pairs.column("n").to_numpy()
    network = attention.initial(counts.reshape(IDS + 1, IDS))
    for turn in range(ROUNDS if tokens else 0):
        network, _ = _round(gathered, network, tokens, turn)
    return network


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Scorer = shared.value
        for whole in batches:
            for b in T.slices(whole, "text"):
                raw, at = T.buffers(b.column("text"))
                words = T.Words(raw, at, lower=True)
                n = b.num_rows
                ids, edge = with_ends(words, subwords(raw, words))
                row = np.repeat(np.arange(n), np.diff(edge))
                p = attention.log_probabilities(s.network, ids, edge).astype(np.float64) / np.log(10) - s.share[ids]
                key, back = np.unique(words.hash.view(np.int64), return_inverse=True)
                if len(s.key):
                    spot = np.minimum(np.searchsorted(s.key, key), len(s.key) - 1)
                    found = s.key[spot] == key
                    value = np.where(found, s.value[spot], 0.0)
                else:
                    found, value = np.zeros(len(key), bool), np.zeros(len(key))
                hit = found[back]
                loose = np.zeros(0, np.int64) if s.complete else np.flatnonzero(~hit)
                rest = np.concatenate([[0], np.cumsum(np.bincount(words.row[loose], minlength=n))])
                yield T.columns(SCORED, doc_id=b.column("doc_id"), held_out=b.column("held_out"), n_tokens=np.diff(edge),
                    known=np.bincount(words.row[hit], minlength=n) + int(s.end_known), seen=np.bincount(words.row, weights=value[back], minlength=n) + s.end,
                    model=np.bincount(row, weights=p, minlength=n), rest=T.lists(key[back[loose]], rest, pa.int64()))

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    ``docs`` has doc_id, text and held_out; rows that are not held out train. Tokens are the
    words (A-Z lower-cased) and one end. base_score sums log10((c + 1) / (N + V + 1)) over the
    tokens; score is the model's log10 probability of the text. A null, empty or blank text
    is its end alone. Without training rows all words are unseen and N = V = 0. Every row
    counts on its own, also where its id occurs again with the same or another text; equal
    texts get equal scores. Other columns are ignored. Rows without an id are left out. An
    empty table gives an empty result. A text is scored in one task whatever its length.
    """
    spark = docs.sparkSession
    base = storage.workspace(spark, "lm")
    texts = storage.pick(docs, "doc_id", "text", "held_out").fillna(False, ["held_out"])
    training = texts.filter("not held_out").select("doc_id", "text")
    gathered = storage.materialise(training.mapInArrow(_gather, "kind int, key long, id int, n long, data binary"), base, "gathered", heavy=True)
    counts = storage.materialise(gathered.filter(F.col("kind") == WORDS).groupBy("key").agg(F.max("id").alias("id"), F.sum("n").alias("c")), base, "counts", heavy=True)
    n_docs = training.count()
    by_id = counts.groupBy("id").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()  # at most IDS rows
    n, v = np.zeros(IDS), np.zeros(IDS)
    for r in by_id:
        n[r.id], v[r.id] = r.n, r.v
    n[0], v[0] = n_docs, min(1, n_docs)
    total, distinct = int(n.sum()), int(v.sum())

    # The least count whose words, with all more frequent ones, are at most HEAD.
    often = counts.groupBy(F.least("c", F.lit(1 << 20)).alias("c")).agg(F.count(F.lit(1)).alias("words")).collect()
    room, least, left = HEAD, None, distinct - int(v[0])
    for r in sorted(often, key=lambda r: -r.c):
        if r.words > room:
            break
        room, least, left = room - r.words, r.c, left - r.words
    head = counts.filter(F.col("c") >= least).select("key", "c").toArrow() if least is not None else None
    key = head.column("key").to_numpy() if head else np.zeros(0, np.int64)
    value = np.log10(head.column("c").to_numpy() + 1.0) if head else np.zeros(0)
    order = np.argsort(key)
    scorer = Scorer(_network(gathered, total), np.log10(n + v + 1), np.log10(n_docs + 1), n_docs > 0, key[order], value[order], left == 0)
    shared = spark.sparkContext.broadcast(scorer)

    scored = storage.materialise(texts.mapInArrow(_score(shared), "doc_id long, held_out boolean, n_tokens long, known long, seen double, model double, rest array<long>"), base, "scored", heavy=True)
    # Rows of one id may have different texts, so rare words are looked up by what they are.
    scored = scored.withColumn("lm_words", F.xxhash64("rest"))
    loose = scored.filter(F.size("rest") > 0).select("doc_id", "lm_words", "rest").dropDuplicates(["doc_id", "lm_words"]).select("doc_id", "lm_words", F.explode("rest").alias("key"))
    rare = counts.filter(F.col("c") < least) if least is not None else counts
    met = loose.join(rare.select("key", "c").hint("merge"), "key").groupBy("doc_id", "lm_words").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("c") + 1.0)).alias("extra"))
    both = scored.drop("rest").join(met, ["doc_id", "lm_words"], "left")
    seen = F.col("seen") + F.coalesce("extra", F.lit(0.0))
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (seen - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))).alias("base_score"), (seen + F.col("model")).alias("score"),
    )
