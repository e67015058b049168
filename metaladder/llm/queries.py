"""The subpackage's queries over the driver's tables, at production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, language_id, language_model, media, mixing, near_dedup, sentencepiece, storage, substring_dedup, token_records, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as deduplicated chunks, read back and verified."""
    return media.store_and_read(_documents(spark, sf_dir))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by a public BPE model and decoded again."""
    made = sentencepiece.encode(_documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"), ("n_tokens", "ids_crc32", "decoded", "exact"))
    return made.select("doc_id", "n_tokens", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"), "exact")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to compressed WARC archives and read back."""
    base = storage.workspace(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.read(warc.write(pages, base), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw from all documents towards tempered shares of sources, languages and topics."""
    mixed = mixing.mix(_documents(spark, sf_dir))
    return mixed.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "topic", "n_tokens", F.round("probability", 6).alias("probability"), "selected")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-permutation MinHash near-duplicates of all documents."""
    return near_dedup.near_duplicates(_documents(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left in each document once passages that stand earlier are removed."""
    return substring_dedup.remove_repeats(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive Bayes language of all documents, learnt from four fifths of them."""
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang", language_id.held_out("doc_id", 5, 0).alias("held_out"))
    model = language_id.train(docs.filter("not held_out"))
    return language_id.predict(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token records, read back from the files."""
    base = storage.workspace(spark, "records")
    return token_records.read(token_records.write(_documents(spark, sf_dir), base, tokenizer_path("byte_bpe_50k.json")))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinHash fingerprints of all documents, of their edited texts, their likeness, and classes of verified near pairs."""
    return fingerprints.with_classes(_documents(spark, sf_dir))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention and unigram scores of all documents, learnt from six sevenths of them."""
    docs = _documents(spark, sf_dir).select("doc_id", "text", language_id.held_out("doc_id", 7, 2).alias("held_out"))
    return language_model.score(docs)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_warc": op3_warc,
    "op4_mixing": op4_mixing,
    "op5_near_dedup": op5_near_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_language_id": op7_language_id,
    "op8_token_records": op8_token_records,
    "op9_fingerprints": op9_fingerprints,
    "op10_language_model": op10_language_model,
    "pipeline": pipeline,
}
ORACLE_SQL: dict[str, str] = {"op4_mixing": mixing.oracle()}
