"""WARC archives compressed record by record with Zstandard and a shared dictionary.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary,
followed by one Zstandard frame per record, as in the public .warc.zst convention. The
reader takes the dictionary from that frame, decodes frame by frame, and checks versions,
header fields, content lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from . import textops as T

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
DICTIONARY_BYTES, SAMPLE_BYTES, ARCHIVE_BYTES, LEVEL, SALTS = 64 << 10, 4 << 20, 128 << 20, 3, 16
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVES = pa.schema([("uri", pa.string()), ("n_records", pa.int64())])
RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def build(page_id: int, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit carries the full payload's digest and size but no payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", RESPONSE if refers_to is None else REVISIT),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Target-URI", url),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("X-Page-ID", str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """Fields and payload of one record; raises ValueError where anything does not fit."""
    head, mark, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in fields:
            raise ValueError(f"bad header line {line[:60]!r}")
        fields[name.lower()] = value.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest", "warc-block-digest"} - fields.keys():
        raise ValueError(f"missing {sorted(missing)}")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("the content length does not match the record")
    block = rest[:size]
    if fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError("the block fails its digest")
    http, mark, payload = block.partition(b"\r\n\r\n")
    if not mark or not http.startswith(b"HTTP/"):
        raise ValueError("no HTTP header in the block")
    if fields["warc-type"] == RESPONSE and (fields["warc-payload-digest"] != f"sha1:{digest(payload)}" or len(payload) != int(fields["x-payload-length"])):
        raise ValueError("the payload fails its digest or length")
    if fields["warc-type"] == REVISIT and (payload or "warc-refers-to" not in fields):
        raise ValueError("a revisit with a payload or without a reference")
    return fields | {"payload": payload}


def dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary from sample records, or raw content where they are too few to train."""
    import zstandard

    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 10)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b"WARC/1.1\r\n"


class Writer:
    """One archive; the dictionary is trained on the records buffered before the first write."""

    def __init__(self, base: str):
        self.file, self.buffer, self.held, self.n, self.packer = storage.TaskFile(base, ".warc.zst"), [], 0, 0, None

    def _start(self) -> None:
        import zstandard

        data = dictionary(self.buffer)
        self.file.write(struct.pack("<II", SKIPPABLE, len(data)) + data)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data), write_checksum=True, write_content_size=True)
        for record in self.buffer:
            self.file.write(self.packer.compress(record))
        self.buffer = []

    def add(self, record: bytes) -> None:
        self.n += 1
        if self.packer:
            self.file.write(self.packer.compress(record))
        else:
            self.buffer.append(record)
            self.held += len(record)
            if self.held >= SAMPLE_BYTES:
                self._start()

    def close(self) -> pa.RecordBatch:
        if not self.packer:
            self._start()
        return T.columns(ARCHIVES, uri=[self.file.close()], n_records=[self.n])


class Frames:
    """Records of one archive: the dictionary from the leading frame, then a frame at a time."""

    def __init__(self, source, chunk: int = 1 << 20, piece: int = 4 << 10):
        import zstandard

        self.source, self.chunk, self.piece = source, chunk, piece
        magic, size = struct.unpack("<II", self._exactly(8))
        if magic != SKIPPABLE:
            raise ValueError("the archive does not begin with a dictionary frame")
        data = self._exactly(size)
        if data[:4] == struct.pack("<I", FRAME):  # the convention allows a compressed dictionary
            data = zstandard.ZstdDecompressor().decompress(data)
        self.unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))

    def _exactly(self, n: int) -> bytes:
        data = self.source.read(n)
        if len(data) != n:
            raise ValueError("the archive ends early")
        return data

    def __iter__(self) -> Iterator[bytes]:
        data, at, out, left = b"", 0, [], None
        while True:
            if len(data) - at < 4:
                more = self.source.read(self.chunk)
                data, at = data[at:] + more, 0
                if not more and not data:
                    break
            if left is None:
                if data[at : at + 4] != struct.pack("<I", FRAME):
                    raise ValueError("a frame without the Zstandard magic number")
                left = self.unpacker.decompressobj()
            # A piece at a time: what a frame leaves of it is copied, and records are small.
            piece = memoryview(data)[at : at + self.piece]
            if not len(piece):
                raise ValueError("the archive ends inside a frame")
            out.append(left.decompress(piece))
            at += len(piece)
            if left.eof:
                at -= len(left.unused_data)
                yield b"".join(out)
                out, left = [], None
            elif at == len(data):
                data, at = self.source.read(self.chunk), 0
                if not data:
                    raise ValueError("the archive ends inside a frame")


def originals(pages: DataFrame, base: str, min_revisit_bytes: int) -> DataFrame:
    """``sha1, n_bytes, original``: of pages with equal payloads of at least that size, the largest id."""
    keyed = pages.select("page_id", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("n_bytes"))
    many = keyed.groupBy("sha1", "n_bytes").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
    return storage.materialise(many.filter((F.col("n") > 1) & (F.col("n_bytes") >= min_revisit_bytes)).drop("n"), base, "originals")


def write(pages: DataFrame, base: str, *, min_revisit_bytes: int = 0) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); returns (uri, n_records) of the archives.

    A null html is an empty payload, a null url an empty target. Of equal payloads of at least
    ``min_revisit_bytes`` bytes the largest page_id is the response and the others revisit it;
    where that page_id itself repeats with equal html, each of its rows is a response. An empty
    table writes no archive. Other columns are ignored. Rows without a page_id are left out.
    A page of any length is one record, built whole in one task.
    """
    picked = storage.pick(pages, "page_id", "url", "html", key="page_id").fillna("", ["url", "html"])
    rows = picked.select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    owner = originals(rows, base, min_revisit_bytes)
    # Payloads that many pages share are dealt over SALTS keys, so none of them fills a task.
    salted = owner.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = rows.withColumns({"sha1": F.sha1("payload"), "n_bytes": F.octet_length("payload"), "salt": F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")})
    joined = keyed.join(salted, ["sha1", "n_bytes", "salt"], "left")
    ready = joined.select("page_id", "url", "payload", F.when(F.col("original") != F.col("page_id"), F.col("original")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for b in batches:
            for page_id, url, payload, refers_to in zip(*(b.column(k).to_pylist() for k in range(4))):
                writer = writer or Writer(f"{base}/archives")
                writer.add(build(page_id, " ".join(url.split()), payload, refers_to))
                if writer.file.offset >= ARCHIVE_BYTES:
                    yield writer.close()
                    writer = None
        if writer:
            yield writer.close()

    return storage.materialise(ready.mapInArrow(run, "uri string, n_records long"), base, "manifest")


def read(archives: DataFrame, *, payloads: bool = True) -> DataFrame:
    """Records of the listed archives: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, payload (null for revisits, or where ``payloads`` is false). Damage raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column("uri").to_pylist():
                fs, path = storage.filesystem(uri)
                held, size = [], 0
                with fs.open_input_stream(path, compression=None) as source:
                    for record in Frames(source):
                        x = parse(record)
                        refers = x.get("x-refers-to-page-id")
                        held.append((int(x["x-page-id"]), x.get("warc-target-uri", ""), int(x["x-payload-length"]), x["warc-payload-digest"].removeprefix("sha1:"), x["warc-type"], int(refers) if refers else None, x["payload"] if payloads and x["warc-type"] == RESPONSE else None))
                        size += len(record)
                        if size >= T.SLICE:
                            yield T.columns(RECORDS, **dict(zip(RECORDS.names, map(list, zip(*held)))))
                            held, size = [], 0
                if held:
                    yield T.columns(RECORDS, **dict(zip(RECORDS.names, map(list, zip(*held)))))

    parts = max(1, archives.count())
    return archives.repartition(parts).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
