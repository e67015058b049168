"""Media columns: payloads stored as content-defined chunks, each distinct chunk once.

* A rolling gear hash over 32 bytes proposes cuts where its top bits are zero; chunks keep
  to ``MIN`` and ``MAX`` bytes. Cuts depend on nearby bytes alone, so equal passages of
  different payloads give equal chunks.
* Chunks are named by their SHA-256. Spark joins find one holder of each digest, so the
  store has every chunk once, as its own Zstandard frame under the store's dictionary.
* A payload is an ordered list of chunk digests, and the hash of that list names it. Each
  distinct payload is read back once: chunk by chunk from the store where it is one chunk,
  otherwise by joining its list with the store. Every chunk is verified against its digest
  and every payload against its name; then all documents meet their payload's features.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from . import textops as T

UNIT, MIN, MAX, BITS, LEVEL = 64, 4 << 10, 64 << 10, 13, 6
#: The dictionary that all frames of a store share: its size, and the sample it is trained on.
DICTIONARY, SAMPLE_ROWS, SAMPLE_CHARS = 32 << 10, 512, 16 << 10
GEAR = (T.seeded(256, 0x6EA2) >> np.uint64(32)).astype(np.uint32)

RECIPES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_key", pa.binary()), ("digests", pa.list_(pa.binary()))])
CHUNKS = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("frame", pa.binary())])
FEATURES = pa.schema([("payload_key", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
FEATURE_DDL = "payload_key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(payload: bytes, unit: int = UNIT) -> bytes:
    """The payload with zero bytes up to a positive multiple of ``unit``."""
    return payload + bytes(-len(payload) % unit if payload else unit)


def gear(raw: np.ndarray) -> np.ndarray:
    """Rolling hash at every byte: the sum of GEAR[byte j back] * 2**j over 32 bytes, modulo 2**32."""
    run, size = GEAR[raw], 1
    while size < 32:
        more = run.copy()
        more[size:] += run[:-size] << np.uint32(size)
        run, size = more, size * 2
    return run


def cuts(raw: np.ndarray, least: int = MIN, most: int = MAX, bits: int = BITS) -> list[int]:
    """Ends of the chunks of a payload, its length last."""
    n, out, begin = len(raw), [], 0
    if n > least:
        proposed = np.flatnonzero(gear(raw) >> np.uint32(32 - bits) == 0) + 1
        while n - begin > least:
            k = int(np.searchsorted(proposed, begin + least))
            end = min(int(proposed[k]) if k < len(proposed) else n, begin + most, n)
            out.append(end)
            begin = end
    if begin < n:
        out.append(n)
    return out


def pieces(payload: bytes) -> list[bytes]:
    """The payload's chunks in order."""
    ends = cuts(np.frombuffer(payload, np.uint8))
    return [payload[x:y] for x, y in zip([0, *ends], ends)]


def key_of(digests: list[bytes]) -> bytes:
    """Name of a payload: the hash of its chunk list."""
    return hashlib.sha256(b"".join(digests)).digest()


def _payloads(batches: Iterator[pa.RecordBatch], unit: int) -> Iterator[list[tuple[int, int, bytes]]]:
    for whole in batches:
        for b in T.slices(whole, "text"):
            raw, at = T.buffers(b.column("text"))
            data = raw.tobytes()
            yield [(d, int(hi - lo), padded(data[lo:hi], unit)) for d, lo, hi in zip(b.column("doc_id").to_pylist(), at[:-1], at[1:])]


def _recipes(unit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _payloads(batches, unit):
            lists = [[hashlib.sha256(x).digest() for x in pieces(p)] for _, _, p in part]
            yield T.columns(RECIPES, doc_id=[d for d, _, _ in part], n_bytes=[n for _, n, _ in part], payload_key=list(map(key_of, lists)), digests=lists)

    return run


def dictionary(texts: DataFrame) -> bytes:
    """Trained on the starts of the ``SAMPLE_ROWS`` documents with the least hashes of their
    ids; empty where they are too few."""
    import zstandard

    # A range of the hash that holds a few times as many rows first: what is sorted stays
    # small however many partitions there are.
    share = min(1.0, 4 * SAMPLE_ROWS / max(1, texts.count()))
    near = F.xxhash64("doc_id") <= F.lit(int(-(1 << 63) + share * ((1 << 64) - 1025)))
    sample = texts.filter(near & F.col("text").isNotNull()).select(F.xxhash64("doc_id").alias("h"), F.substring("text", 1, SAMPLE_CHARS).alias("text")).orderBy("h", "text").limit(SAMPLE_ROWS)
    rows = [r.text.encode() for r in sample.collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY, rows).as_bytes()
    except zstandard.ZstdError:
        return b""


def _shared(words: bytes) -> dict:
    import zstandard

    return {"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}


def _frames(unit: int, words: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=True, write_dict_id=False, **_shared(words))
        for part in _payloads(batches, unit):
            rows = [(d, digest, packer.compress(x)) for d, _, p in part for digest, x in {hashlib.sha256(x).digest(): x for x in pieces(p)}.items()]
            yield T.columns(CHUNKS, **dict(zip(CHUNKS.names, map(list, zip(*rows)))))

    return run


def _read(parts: list[tuple[bytes, bytes]], unpacker) -> tuple:
    """Features of a payload from its (digest, frame) pairs in order; raises on damage."""
    chunks = [unpacker.decompress(frame) for _, frame in parts]
    if any(hashlib.sha256(x).digest() != digest for x, (digest, _) in zip(chunks, parts)):
        raise ValueError("a stored chunk does not match its digest")
    payload, media = b"".join(chunks), b"".join(frame for _, frame in parts)
    return key_of([d for d, _ in parts]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return T.columns(FEATURES, **dict(zip(FEATURES.names, map(list, zip(*rows)))))


def _single(words: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor(**_shared(words))
        for b in batches:
            if b.num_rows:
                yield _batch([_read([x], unpacker) for x in zip(b.column("digest").to_pylist(), b.column("frame").to_pylist())])

    return run


def _assembled(batches: Iterator[pa.RecordBatch], words: bytes) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (payload_key, place) to one row per payload."""
    import zstandard

    unpacker, now, key, parts = zstandard.ZstdDecompressor(**_shared(words)), None, b"", []

    def done() -> tuple:
        out = _read(parts, unpacker)
        if out[0] != key:
            raise ValueError("a payload does not match its chunk list")
        return out

    for b in batches:
        rows = []
        for name, digest, frame in zip(*(b.column(c).to_pylist() for c in ("payload_key", "digest", "frame"))):
            if name != now:
                if parts:
                    rows.append(done())
                now, key, parts = name, name, []
            parts.append((digest, frame))
        if rows:
            yield _batch(rows)
    if parts:
        yield _batch([done()])


def feature_of(payload: bytes) -> str:
    """A coarse spectrum: counts of samples in 16 equal ranges, as hex digits of their share, and the mean."""
    samples = np.frombuffer(payload, np.uint8)
    share = np.bincount(samples >> 4, minlength=16) / len(samples)
    return "".join(f"{min(15, int(x * 32)):x}" for x in share) + f"-{samples.mean():.3f}"


def store_and_read(docs: DataFrame, *, unit: int = UNIT) -> DataFrame:
    """Store every text of ``docs`` (doc_id, text) and compute features from what is read back.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, n_chunks for every row. The payload is the text's UTF-8 bytes (a
    null counts as empty) with zero bytes up to a positive multiple of ``unit``; the stored
    form is the payload's frames in order. Equal texts, and texts that differ only in zero
    bytes at the end, share a payload. Repeated rows and rows of one id with different texts
    are all returned; an empty table stores nothing. Other columns are ignored. Rows without
    an id are left out. A text is cut in one task, however long; its chunks are at most
    ``MAX`` bytes.
    """
    spark = docs.sparkSession
    base = storage.workspace(spark, "media")
    texts = storage.pick(docs, "doc_id", "text")
    recipes = storage.materialise(texts.mapInArrow(_recipes(unit), "doc_id long, n_bytes long, payload_key binary, digests array<binary>"), base, "recipes")
    words = dictionary(texts)
    heads = storage.materialise(recipes.groupBy("payload_key").agg(F.min("doc_id").alias("doc_id")), base, "heads", heavy=True)
    payloads = recipes.select("payload_key", "doc_id", "digests").join(heads.hint("merge"), ["payload_key", "doc_id"]).distinct()
    payloads = storage.materialise(payloads, base, "payloads", heavy=True)
    storage.drop(spark, f"{base}/heads")
    one = F.size("digests") == 1
    uses = payloads.select("doc_id", one.alias("one"), F.explode(F.array_distinct("digests")).alias("digest"))
    holders = storage.materialise(uses.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.bool_or("one").alias("single"), F.bool_or(~F.col("one")).alias("part")), base, "holders", heavy=True)
    # The document is part of the key, so a digest that many documents share is spread out.
    framed = texts.mapInArrow(_frames(unit, words), "doc_id long, digest binary, frame binary").join(holders.hint("merge"), ["digest", "doc_id"])
    spark.createDataFrame([(bytearray(words),)], "words binary").write.parquet(f"{base}/dictionary")  # the store's, for later readers
    store = storage.materialise(framed.dropDuplicates(["digest", "doc_id"]).select("digest", "single", "part", "frame"), base, "store", heavy=True)

    alone = store.filter("single").select("digest", "frame").mapInArrow(_single(words), FEATURE_DDL)
    listed = payloads.filter(~one).select("payload_key", F.posexplode("digests").alias("place", "digest"))
    found = listed.join(store.filter("part").select("digest", "frame").hint("merge"), "digest").repartition("payload_key").sortWithinPartitions("payload_key", "place")
    features = storage.materialise(alone.union(found.select("payload_key", "digest", "frame").mapInArrow(lambda batches: _assembled(batches, words), FEATURE_DDL)), base, "features", heavy=True)
    return recipes.select("doc_id", "n_bytes", "payload_key", F.size("digests").alias("n_chunks")).join(features, "payload_key").select("doc_id", "n_bytes", *FEATURES.names[1:], "n_chunks")
