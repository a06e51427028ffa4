"""The queries of this subpackage: each operator over its whole table, and the SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeq.llm import (
    counts, exact, language, negatives, packing, pieces, quality, repair, reputation, sharding, simhash, substring,
    tokenfiles)
from codeq.llm.common import documents
from codeq.llm.subwords import vocabulary
from codeq.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(job):
        QUERIES[job.__name__] = job
        if sql is not None:
            SQL[job.__name__] = sql
        return job
    return register


@query()
def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring.passages(documents(spark, folder))


@query("""
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.owners(documents(spark, folder))


@query()
def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "llm-tokens")
    tokenfiles.write_tokens(documents(spark, folder), path, vocabulary("byte_bpe_50k.json"))
    return tokenfiles.token_index(tokenfiles.read_tokens(spark, path))


@query()
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counts.token_counts(documents(spark, folder), vocabulary("byte_bpe_50k.json"))


@query()
def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.packed_pieces(
        documents(spark, folder), vocabulary("word_bpe_49k.json"), with_ids=False)
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"),
                         "ids_crc32", "sequence_id", "offset")


@query(quality.SQL)
def op6_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.clean_lines(documents(spark, folder), with_text=False).drop("clean_text")


@query()
def op7_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encoded(
        documents(spark, folder), vocabulary("piece_bpe_32k.model"), with_ids=False).drop("ids")


@query()
def op8_sampled_shards(spark: SparkSession, folder: str) -> DataFrame:
    sharded = sharding.shard(documents(spark, folder).select(
        "doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")),
        with_text=False)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                          F.lit(None).cast("int").alias("grown_shard"))


@query()
def op9_language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return language.languages(documents(spark, folder))


@query()
def op10_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder))


@query(reputation.SQL)
def op11_host_reputation(spark: SparkSession, folder: str) -> DataFrame:
    return reputation.judged(spark.read.parquet(f"{folder}/pages.parquet"),
                             spark.read.parquet(f"{folder}/labels.parquet")).drop("bad_share", "bad_bound")


@query(repair.SQL)
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = spark.read.parquet(f"{folder}/conversations.parquet")
    return repair.repairs(repair.damaged(conversations), conversations)


@query(negatives.SQL)
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = negatives.relabelled(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return negatives.mined(negatives.whole_vectors(rows), F.col("vec_id") % 100 == 0)
