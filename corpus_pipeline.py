"""A corpus from raw documents to packed sequences; each stage calls one operator of shroud.llm and works on all that the one before kept.

Every stage takes null ids, null, empty and very long texts, repeated rows and empty tables, and passes further columns on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shroud.llm import ngram_join, packing, pii, quality, suffix_dedup
from shroud.llm.queries import PASSAGE, tokenizer_path
from shroud.llm.shared import drop_staged, read_table, staged_alone

def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows a text that a stage has changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the upper grade is a half or more; learnt from the labelled ones among docs. Null and empty
    texts are judged by their figures; without labels all stay, ties at a half stay."""
    return quality.keep_good(docs, quality.train(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates; a row repeated whole is a duplicate too. Texts without words all stay."""
    return ngram_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the bytes that repeated strings of 400 bytes or of over 50 words cover; all rows stay, a null text stays null."""
    return _measured(suffix_dedup.remove_repeats(docs, words=PASSAGE))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets; all rows stay, a null text stays null."""
    return _measured(pii.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, with their ids (little-endian, 4 bytes each); a null or empty text is its end token alone."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", good_quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("personal_data", personal_data), ("packing", packed)]

#: SQL can't express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order: what the last one gives."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
        if name != STAGES[0][0]:
            drop_staged(before)
    return STAGES[-1][1](spark, docs, sf_dir)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of all pieces, without their ids."""
    return sequences(spark, sf_dir).drop("ids")
