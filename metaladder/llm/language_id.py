"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams of code points per language with numpy inside map tasks and
sums them in Spark, so the model sees every labelled document handed to it. The
log-probability matrix has ``BUCKETS`` columns and one row per language. It is broadcast;
``MAX_LANGUAGES`` bounds its size (32 MB at the defaults) and more languages are an error.
Scoring adds, for each document, the matrix columns of its n-grams: a sparse product that is
done on flat arrays for many documents at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import storage
from . import textops as T

BUCKETS, ORDERS, MAX_LANGUAGES, SMOOTHING = 1 << 14, (2, 3), 512, 0.5
UNDETERMINED = "und"


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased code points, offsets) of a text column; each text is framed by blanks."""
    texts = [f" {t.lower()} " if t else "  " for t in column.to_pylist()]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), at


def hashed(points: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each code point (the last ones wrap to nothing)."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, (0x9E3779B1 * order) & 0xFFFFFFFF, np.uint32)
    for j in range(order):
        h = (h ^ points[j : j + n]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return (h & np.uint32(buckets - 1)).astype(np.int64)


COUNTS = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])


def _count(buckets: int, orders: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for b in T.slices(whole, "text"):
                points, at = code_points(b.column("text"))
                names = sorted(set(b.column("lang").to_pylist()))
                code = np.repeat(np.searchsorted(names, b.column("lang").to_pylist()), np.diff(at))
                row = np.repeat(np.arange(b.num_rows), np.diff(at))
                sums = np.zeros(len(names) * buckets, np.int64)
                for k in orders:
                    h = hashed(points, k, buckets)
                    inside = row[: len(h)] == row[k - 1 :]  # n-grams that run over a text's end are left out
                    sums += np.bincount((code[: len(h)] * buckets + h)[inside], minlength=len(sums))
                for lang, own in zip(names, sums.reshape(len(names), buckets)):
                    total[lang] = total.get(lang, 0) + own
        for lang, sums in total.items():
            at = np.flatnonzero(sums)
            yield T.columns(COUNTS, lang=[lang] * len(at), bucket=at, n=sums[at])

    return run


class Model:
    """Languages in ascending order and float32 log probabilities, (buckets, languages)."""

    def __init__(self, languages: list[str], prior: np.ndarray, table: np.ndarray, orders: tuple[int, ...]):
        self.languages, self.prior, self.table, self.orders = languages, prior, table, orders


def train(docs: DataFrame, *, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> Model:
    """Fit on every row of ``docs`` (text, lang) whose text and lang are not null.

    Priors are uniform, so how often a language occurs in the training rows decides nothing.
    No usable row gives a model without languages, which calls everything undetermined, and
    so does an empty table. Repeated rows count each. More than ``MAX_LANGUAGES`` languages
    are an error, for the model would have no bound.
    """
    rows = storage.unclashed(docs, "text", "lang").select("text", "lang").filter("text is not null and lang is not null")
    n_langs = rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if n_langs > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counted = rows.mapInArrow(_count(buckets, orders), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # at most MAX_LANGUAGES * buckets rows
    languages = sorted(set(found.column("lang").to_pylist()))
    sums = np.zeros((buckets, len(languages)))
    place = {x: i for i, x in enumerate(languages)}
    sums[found.column("bucket").to_numpy(), [place[x] for x in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
    table = np.log((sums + SMOOTHING) / (sums.sum(axis=0) + SMOOTHING * buckets)) if languages else sums
    return Model(languages, np.full(len(languages), -math.log(max(1, len(languages)))), table.astype(np.float32), orders)


def score(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Best language and its posterior probability for each text."""
    points, at = code_points(column)
    n = len(at) - 1
    if not model.languages:
        return [UNDETERMINED] * n, np.zeros(n)
    total = np.tile(model.prior, (n, 1)).astype(np.float64)
    for k in model.orders:
        h = hashed(points, k, len(model.table))
        # n-grams that run over a text's end are left out.
        lo, hi = at[:-1], np.maximum(at[:-1], at[1:] - k + 1)
        edges = np.stack([lo, hi], axis=1).reshape(-1)
        picked = model.table[h]
        padded = np.concatenate([picked, np.zeros((1, picked.shape[1]), np.float32)])
        sums = np.add.reduceat(padded, np.minimum(edges, len(picked)), axis=0, dtype=np.float64)[::2]
        total += np.where((hi > lo)[:, None], sums, 0)
    best = total.argmax(axis=1)
    share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    lettered = np.array([any(map(str.isalpha, t or "")) for t in column.to_pylist()], bool)
    names = [model.languages[i] if ok else UNDETERMINED for i, ok in zip(best, lettered)]
    return names, np.where(lettered, share, 0.0)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``score`` (0 to 1); reads ``text`` alone.

    A text that is null or has no letter is ``und`` with score 0. Of equally likely languages
    the alphabetically first wins. Columns named lang_pred or score are replaced.
    Every row is returned, repeated ones and those without an id too; an empty table gives an
    empty result. A text is read whole in one task, however long.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    docs = storage.unclashed(docs, "text").drop("lang_pred", "score")
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in T.slices(whole, "text"):
                names, share = score(shared.value, b.column("text"))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(share)], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def held_out(id_column: str, parts: int, part: int):
    """Whether crc32 of the id as text leaves ``part`` modulo ``parts``."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % parts == part
