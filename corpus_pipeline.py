"""Corpus pipeline: language ID, exact dedup, near dedup, source mix, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verdictlake.llm import exact_dedup, langid, mixing, packing, simhash_dedup
from verdictlake.llm.common import load, save


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has no identifiable language go.

    Null texts and texts without a letter go; a text with a letter stays where no labelled
    row allows a model. Repeated rows stay or go alike, null ids and null lang or source
    stay as they are, an empty table stays empty.
    """
    return langid.known_language(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays.

    A null text is an empty one; a null id stays only where its whole group has none; of
    rows that repeat id and text one stays; an empty table stays empty.
    """
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document with the smallest id stays.

    Near is op2's contract, 4-word shingles and at most 4 of 64 bits: texts of a cosine around 0.98 and more.
    Texts without words (null ones too) are one class; of rows that repeat the id that
    stays, one stays; a null id stays only in a class of null ids; an empty table stays empty.
    """
    return simhash_dedup.drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights: documents are repeated or left out.

    A null source is a source of its own, after the others; null and empty texts stay
    once; rows that repeat an id are all taken as often as the one taken most; an empty
    table stays empty.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths.

    A null text is an empty one, a piece of the end id alone; repeated rows are packed each
    for itself; an empty table gives no pieces.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("simhash_dedup", near_copies),
    ("source_mix", source_mix),
    ("packing", pack),
]

#: Neither the language model nor the tokenizer can be written in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
