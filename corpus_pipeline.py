"""A corpus pipeline over the documents: language, copies, near copies, repeated passages, packing."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from codeq.llm import exact, language, packing, similar, substring
from codeq.llm.common import documents, drop, recorded, settle
from codeq.llm.subwords import vocabulary

_between: list[str] = []  # folders that the last stage called has written on its way


def _stage(function):
    """A stage drops what the one before it wrote on its way: that one's rows were written, as all stages' are."""
    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, _between)
        with recorded(_between):
            return function(spark, docs, sf_dir)
    return run


@_stage
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose learned languages together hold half of their words or more.

    Null text, or text without letters, has no language and goes. Repeated rows are judged alike; no rows give none.
    """
    return language.in_known_language(docs)


@_stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest doc_id.

    Null text is empty; null ids come before all others. Of equal rows one stays; no rows give none.
    """
    return exact.distinct_texts(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, 0.8 alike in 5-word shingles, that with the smallest doc_id.

    Documents without words are one group, null text among them. Null ids come last; no rows give none.
    """
    return similar.one_of_each(docs)


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that an earlier document has.

    Null text has no words. "Earlier" is by row, also among equal ids; no rows give none.
    """
    return substring.drop_passages(docs)


@_stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, with the sequence and the place each goes to.

    Null text is one end token. Rows of one id are packed as they are, each; no rows give none.
    """
    return packing.packed_pieces(docs, vocabulary("word_bpe_49k.json"), with_ids=False).drop("ids")


STAGES = [
    ("language", known_language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]
ORACLE_SQL = None  # mixtures, alignments and tokenizers are beyond SQL; tests hold the stages to plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
