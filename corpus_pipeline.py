"""A corpus pipeline from five operators: what is left of ``documents`` and its token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of documents
with the rows or words they keep; the last adds token ids. A stage works on everything its
predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaladder.llm import language_id, mixing, near_dedup, sentencepiece, storage, substring_dedup
from metaladder.llm.queries import tokenizer_path

#: Documents below this posterior, and those without a letter, have no certain language.
MIN_SCORE = 0.5


def _plain(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` under names that no operator uses, keep_0 and so on, and the named columns beside them."""
    cols = docs.columns
    return docs.toDF(*(f"keep_{i}" for i in range(len(cols)))).select("*", *(F.col(f"keep_{cols.index(n)}").alias(n) for n in names))


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows with the columns of ``docs``."""
    return rows.select(*(f"keep_{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Naive Bayes trained on the labelled rows; documents of undetermined language go.

    A null, empty or letterless text is undetermined. Without a labelled row nothing is
    rejected. Every row is judged by its own text, repeated ones and those without an id too;
    other columns stay as they are, whatever their names. An empty table stays empty.
    """
    model = language_id.train(docs)
    if not model.languages:
        return docs
    named = language_id.predict(_plain(docs, "text"), model)
    return _back(named.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= MIN_SCORE)), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id.

    Rows of one id are one document and stay or go together. Rows without an id have no place
    in that order and stay, as do null and empty texts. Other columns stay as they are. An
    empty table stays empty.
    """
    kept = near_dedup.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = _plain(docs, "doc_id")
    found = rows.join(kept.hint("merge"), rows["doc_id"] == kept["kept_id"], "left_semi")
    return _back(found.unionByName(rows.filter("doc_id is null")), docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier are cut out; documents of which nothing is left go.

    A text that loses nothing stays as it is, white space included; so do null and empty
    texts and rows without an id. ``n_chars`` follows. Rows of one id are read as one
    document. Other columns stay as they are. An empty table stays empty.
    """
    cut = substring_dedup.remove_repeats(docs).filter("n_removed > 0").select(F.col("doc_id").alias("cut_id"), F.col("text_hash").alias("cut_hash"), "kept_text", (F.col("n_words") - F.col("n_removed")).alias("left"))
    cut = storage.materialise(cut, storage.workspace(spark, "cut"), "texts", heavy=True).dropDuplicates(["cut_id", "cut_hash"])
    rows = _plain(docs, "doc_id", "text")
    joined = rows.join(cut.hint("merge"), (rows["doc_id"].cast("long") == cut["cut_id"]) & (F.xxhash64(rows["text"]) == cut["cut_hash"]), "left").filter("left is null or left > 0")
    place = {n: f"keep_{docs.columns.index(n)}" for n in ("text", "n_chars")}
    new = F.when(F.col("left").isNotNull(), F.col("kept_text"))
    joined = joined.withColumns({place["text"]: F.coalesce(new, place["text"]), place["n_chars"]: F.coalesce(F.char_length(new), place["n_chars"]).cast(docs.schema["n_chars"].dataType)})
    return _back(joined, docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn towards tempered shares of sources, languages and topics.

    Null sources, languages and texts count as empty ones, and texts without words are not
    drawn. Repeated rows share their decision; rows without an id are drawn as one. Other
    columns stay as they are. An empty table stays empty.
    """
    return _back(mixing.mix(_plain(docs, "doc_id", "text", "source", "lang")).filter("selected"), docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens and ids under a public SentencePiece model, of every row.

    A null or empty text has no ids. Repeated rows, rows without an id and texts of any
    length are encoded whole; other columns are left behind. An empty table stays empty.
    """
    names = ("doc_id", "source", "lang", "text")
    return sentencepiece.encode(_plain(docs, *names).select(*names), tokenizer_path("piece_bpe_32k.model"), ("n_tokens", "ids")).select("doc_id", "source", "lang", "n_tokens", "ids")


STAGES = [
    ("language_id", identify),
    ("near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("mixing", mixed),
    ("sentencepiece", tokenised),
]

#: SQL expresses neither the trained classifier nor the tokenizer; tests compare the stages
#: with plain Python versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = storage.workspace(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = storage.materialise(stage(spark, docs, sf_dir), base, name)
        if k:
            storage.drop(spark, f"{base}/{STAGES[k - 1][0]}")
    return docs
