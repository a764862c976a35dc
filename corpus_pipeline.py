"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between two
stages the rows are written as Parquet and read again. All but the last return
the columns of ``documents``. A null or empty text is kept by every stage and
has no tokens in the end; rows that repeat an id are one document to the near
duplicates, of which one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, jaccard, lines, sentencepiece, toxicity
from lodestone.runtime import drop, fresh, materialize


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nnPU classifier scores at 0.5 or more go. A null or empty text has the score of one without
    evidence; without positive labels nothing goes; extra columns are kept, whatever their names."""
    return toxicity.keep_clean(docs, _read(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, from 20 characters up to two edits; blank lines stay; n_chars, where
    there is such a column, follows a text that changes. Null texts and rows with a null id stay as they are."""
    before, removed = fresh(docs, "n_lines", "n_removed")
    out = lines.deduplicate(docs, counts=(before, removed))
    changed = {"n_chars": F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.withColumns(changed).select(*(F.col(f"`{c}`") for c in docs.columns))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a 5-word shingle similarity of 0.8, the smallest id stays. Null and
    empty texts and rows with a null id stay; of rows that repeat an id, the one with the least text."""
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; null and empty texts and items contain nothing."""
    return decontaminate.keep_clean(docs, _read(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, and the digest of the text decoded from them; a null text has no tokens."""
    out = sentencepiece.encode(docs)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", tokenize),
]

#: The classifier and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        following = materialize(stage(spark, docs, sf_dir), name)
        if k:  # what this stage has read is no longer needed
            drop(docs)
        docs = following
    return STAGES[-1][1](spark, docs, sf_dir)
