"""SentencePiece encoding and decoding of a table's texts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from . import pieces, storage
from . import textops as T

KINDS = {
    "n_tokens": (LongType(), pa.int64()),
    "ids": (ArrayType(IntegerType()), pa.list_(pa.int32())),
    "ids_crc32": (LongType(), pa.int64()),
    "decoded": (StringType(), pa.string()),
    "exact": (BooleanType(), pa.bool_()),
}


def encode(docs: DataFrame, model: str, columns: Sequence[str] = ("n_tokens", "ids", "exact")) -> DataFrame:
    """``docs`` with columns from its ``text``: n_tokens, ids, ids_crc32 (of the ids as
    little-endian 32-bit), decoded (the text from the ids) and exact (whether that is the
    text, but for the piece mark, which decodes as a blank).

    A null text is an empty one: no ids, decoded empty. Columns of ``docs`` with the names
    asked for are replaced, all others pass through.
    """
    docs = storage.unclashed(docs, "text").drop(*columns)
    schema = StructType([*docs.schema.fields, *(StructField(c, KINDS[c][0]) for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces.encoder(model)
        for whole in batches:
            for b in T.slices(whole, "text", 4 << 20):
                ids, at = encoder(b.column("text"))
                made = {"n_tokens": at[1:] - at[:-1]}
                if "ids" in columns:
                    made["ids"] = T.lists(ids.astype("int32"), at, pa.int32())
                if "ids_crc32" in columns:
                    made["ids_crc32"] = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(at[:-1], at[1:])]
                if {"decoded", "exact"} & set(columns):
                    made["decoded"] = pieces.decode(encoder.model, ids, at)
                    made["exact"] = [d == (t or "").replace(pieces.SPACE, " ") for d, t in zip(made["decoded"], b.column("text").to_pylist())]
                extra = [made[c] if isinstance(made[c], pa.Array) else pa.array(made[c], KINDS[c][1]) for c in columns]
                yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, *columns])

    return docs.mapInArrow(run, schema)
