"""Token ids as length-delimited binary records with a separate offset index.

Record: length (unsigned 64-bit), masked CRC-32C of the length, payload, masked CRC-32C of
the payload, all little-endian (the TFRecord framing). Payload: document id (signed 64-bit),
bytes per id (unsigned 32-bit), ids of 2 or 4 bytes each. The index beside each file holds
one unsigned 64-bit offset per record, so any record can be read alone and in any order.
Files hold ascending ranges of document ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import checksum, storage
from . import textops as T
from .bpe_units import encoder

END, FILE_BYTES, READ_BYTES = 2, 256 << 20, 4 << 20
HEAD, FOOT, LEAD = 12, 4, 12

FILES = pa.schema([("uri", pa.string()), ("index_uri", pa.string()), ("first_id", pa.int64()), ("first_crc", pa.int64()), ("n_records", pa.int64()), ("n_ids", pa.int64())])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def frame(doc_ids: np.ndarray, ids: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the records of many sequences, and where each begins."""
    body = LEAD + width * np.diff(at)
    begin = np.concatenate([[0], np.cumsum(HEAD + body + FOOT)])
    out = np.zeros(int(begin[-1]), np.uint8)
    flat = ids.astype(f"<u{width}").view(np.uint8)
    lead = np.zeros((len(body), LEAD), np.uint8)
    lead[:, :8] = doc_ids.astype("<i8").view(np.uint8).reshape(-1, 8)
    lead[:, 8:] = np.full(len(body), width, "<u4").view(np.uint8).reshape(-1, 4)
    payload_at = np.concatenate([[0], np.cumsum(body)])
    payload = np.zeros(int(payload_at[-1]), np.uint8)
    payload[(payload_at[:-1, None] + np.arange(LEAD))] = lead
    payload[T.ragged(payload_at[:-1] + LEAD, width * np.diff(at))] = flat
    size = body.astype("<u8").view(np.uint8)
    size_crc = checksum.masked(checksum.crc32c(size, np.arange(len(body) + 1) * 8))
    out[begin[:-1, None] + np.arange(8)] = size.reshape(-1, 8)
    out[begin[:-1, None] + np.arange(8, 12)] = size_crc.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[T.ragged(begin[:-1] + HEAD, body)] = payload
    out[begin[1:, None] + np.arange(-4, 0)] = checksum.masked(checksum.crc32c(payload, payload_at)).astype("<u4").view(np.uint8).reshape(-1, 4)
    return out, begin[:-1]


def unframe(raw: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(document id, ids) of the records that begin at the given places; raises on damage."""
    end = np.append(begin[1:], len(raw))
    size = raw[begin[:, None] + np.arange(8)].copy().view("<u8").reshape(-1).astype(np.int64)
    if (size != end - begin - HEAD - FOOT).any():
        raise ValueError("a record's length does not match the index")
    size_crc = raw[begin[:, None] + np.arange(8, 12)].copy().view("<u4").reshape(-1)
    if (size_crc != checksum.masked(checksum.crc32c(size.astype("<u8").view(np.uint8), np.arange(len(size) + 1) * 8))).any():
        raise ValueError("a record's length fails its checksum")
    payload = raw[T.ragged(begin + HEAD, size)]
    at = np.concatenate([[0], np.cumsum(size)])
    crc = raw[end[:, None] + np.arange(-4, 0)].copy().view("<u4").reshape(-1)
    if (crc != checksum.masked(checksum.crc32c(payload, at))).any():
        raise ValueError("a record's payload fails its checksum")
    data = payload.tobytes()
    for lo, hi in zip(at[:-1], at[1:]):
        width = int.from_bytes(data[lo + 8 : lo + 12], "little")
        yield int.from_bytes(data[lo : lo + 8], "little", signed=True), np.frombuffer(data, f"<u{width}", offset=lo + LEAD, count=(hi - lo - LEAD) // width)


class _Pair:
    """A record file and its index, open for writing."""

    def __init__(self, base: str, first_id: int, first_crc: int):
        self.data, self.index, self.n, self.ids = storage.TaskFile(base, ".records"), storage.TaskFile(base, ".index"), 0, 0
        self.first = {"first_id": [first_id], "first_crc": [first_crc]}

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, at: np.ndarray, width: int) -> None:
        raw, begin = frame(doc_ids, ids, at, width)
        self.index.write((begin + self.data.offset).astype("<u8").tobytes())
        self.data.write(raw.tobytes())
        self.n, self.ids = self.n + len(doc_ids), self.ids + len(ids)

    def close(self) -> pa.RecordBatch:
        return T.columns(FILES, uri=[self.data.close()], index_uri=[self.index.close()], **self.first, n_records=[self.n], n_ids=[self.ids])


def _write(base: str, tokenizer: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pair = encoder(tokenizer), None
        width = 2 if max(encode.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4
        for whole in batches:
            for b in T.slices(whole, "text", 8 << 20):
                ids, at = encode(b.column("text"))
                ids, at = np.insert(ids, at[1:], end), at + np.arange(len(at))
                doc_ids = b.column("doc_id").to_numpy(zero_copy_only=False)
                pair = pair or _Pair(base, int(doc_ids[0]), b.column("crc")[0].as_py())
                pair.add(doc_ids, ids, at, width)
                if pair.data.offset >= FILE_BYTES:
                    yield pair.close()
                    pair = None
        if pair:
            yield pair.close()

    return run


def write(docs: DataFrame, base: str, tokenizer: str, *, end: int = END) -> DataFrame:
    """Write one record per row of ``docs`` (doc_id, text), files in ascending id ranges.

    Returns the table of files (uri, index_uri, first_id, first_crc, n_records, n_ids). Nulls
    are empty texts: a record of the end id alone. Rows with equal ids are ordered by the
    CRC-32 of their text, across files too. An empty table writes no file. Other columns are
    ignored. Rows without an id are left out. A text is encoded whole in one task, however
    long, and is one record.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = storage.pick(docs, "doc_id", "text").fillna("", ["text"])
    ordered = texts.withColumn("crc", F.crc32("text")).repartitionByRange(parts, "doc_id", "crc").sortWithinPartitions("doc_id", "crc", "text")
    return storage.materialise(ordered.mapInArrow(_write(f"{base}/records", tokenizer, end), "uri string, index_uri string, first_id long, first_crc long, n_records long, n_ids long"), base, "files", heavy=True)


def records(uri: str, index_uri: str, limit: int = READ_BYTES) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The records of one file in runs of about ``limit`` bytes."""
    fs, path = storage.filesystem(index_uri)
    with fs.open_input_file(path) as f:
        begin = np.frombuffer(f.read(), "<u8").astype(np.int64)
    fs, path = storage.filesystem(uri)
    with fs.open_input_file(path) as f:
        end = np.append(begin[1:], f.size())
        lo = 0
        while lo < len(begin):
            hi = max(lo + 1, int(np.searchsorted(end, begin[lo] + limit, "right")))
            f.seek(int(begin[lo]))
            raw = np.frombuffer(f.read(int(end[hi - 1] - begin[lo])), np.uint8)
            yield list(unframe(raw, begin[lo:hi] - begin[lo]))
            lo = hi


def read(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every record, verified, from the files.

    ``start`` counts the ids of all documents before it in id order. One row per file reaches
    the driver, to add up the files' id counts.
    """
    spark = files.sparkSession
    rows = sorted(files.collect(), key=lambda r: (r.first_id, r.first_crc, r.uri))
    base, before = [], 0
    for r in rows:
        base.append((r.uri, r.index_uri, before))
        before += r.n_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, index_uri, start in zip(*(b.column(k).to_pylist() for k in range(3))):
                for part in records(uri, index_uri):
                    size = np.array([len(ids) for _, ids in part])
                    crc = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in part]
                    yield T.columns(READ, doc_id=[d for d, _ in part], start=start + np.cumsum(size) - size, n_tokens=size, ids_crc32=crc)
                    start += int(size.sum())

    listed = spark.createDataFrame(base, "uri string, index_uri string, start long").repartition(max(1, len(base)))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
