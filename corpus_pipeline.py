"""The corpus pipeline: from documents to training sequences, each stage calling one operator of the subpackage.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Between
stages the rows are written and read again, so that no stage is computed twice and a lost executor costs little.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.llm import decontamination, language, near_dedup, packing, pii
from helixframe.llm._common import cleanup, mark, table, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; the model is fitted on the labelled part of them.

    Null and empty texts, and those without a letter, go; without any label all go. Texts of any length are read whole;
    repeated rows and null ids stay as they are; no row gives no rows. Columns may have any names.
    """
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    # Rows travel as one column each, so that no name of theirs meets another.
    found = language.identify(docs.select("text", F.struct(*docs.columns).alias("row")), model, columns=("row",))
    return found.where(F.col("lang_pred") != language.UNDETERMINED).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of least doc_id; of rows that repeat as a whole, one.

    Null and empty texts, and those without a word, are duplicates of nothing and stay. Texts of any length are compared
    whole; null ids come last; no row gives no rows. Columns may have any names.
    """
    return near_dedup.without_near_duplicates(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; all, if that is empty.

    Null and empty texts stay. Texts of any length are searched whole; repeated rows and null ids stay as they are; no
    row gives no rows. Columns may have any names.
    """
    return decontamination.without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def pseudonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars, if there is one, is counted anew where a text changes.

    Null and empty texts stay as they are. Texts of any length are read whole; repeated rows change alike; null ids are
    no matter; no row gives no rows. Columns may have any names.
    """
    columns, counted = docs.columns, "n_entities"
    while counted in columns:
        counted += "_"
    out = pii.pseudonymised(docs, pii.session_key(spark), counted=counted)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col(counted) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences, with their token ids.

    A null or empty text is the end id alone. Texts of any length are cut whole; repeated rows give sequences each; null
    ids stay null; no row gives no rows. Other columns, whatever their names, are left behind.
    """
    pieces = packing.pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("language", known_language),
    ("near_duplicates", unique),
    ("decontamination", uncontaminated),
    ("personal_data", pseudonymous),
    ("packing", sequences),
]
#: SQL expresses neither the language model nor the tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training sequences of documents; what a stage has written goes when the next one has been."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        start = mark()
        docs = written(stage(spark, docs, sf_dir), name)
        cleanup(spark, since=start, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
