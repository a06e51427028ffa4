"""Token ids in ORC files, sorted by document.

ORC keeps integers in runs (RLE version 2), a row index every ``stride`` rows with least and greatest
doc_id, and Bloom filters on doc_id; stripes are read by separate tasks. A lookup of documents so
skips files, stripes and row groups by metadata alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeq.llm.common import chunks, settle, through_arrow, whole_text
from codeq.llm.subwords import word_encoder

KNOWN_WORDS = 1_200_000
SCHEMA = "doc_id long, part int, before long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0,
                 stripe_mb: int = 32, stride: int = 1000) -> None:
    """Encode whole texts, each with an end id, and write them in ascending doc_id order.

    Null text is empty. Null doc_ids come first; rows of one doc_id are in the order of a hash of
    their text. ``part`` numbers the ranges of doc_id that became files, ``before`` counts the ids
    ahead of a document in its range.
    """
    def encode(batches):
        encoder, end, before = word_encoder(vocabulary, True, KNOWN_WORDS), end_id.to_bytes(4, "little"), 0
        part = TaskContext.get().partitionId()
        for doc_ids, texts in chunks(batches, "doc_id", "text"):
            coded = [ids + end for ids in encoder.encode(texts)]
            sizes = np.array([len(c) // 4 for c in coded], dtype=np.int64)
            stops = np.cumsum(sizes)
            ids = pa.array(np.frombuffer(b"".join(coded), dtype="<i4"))
            yield {"doc_id": doc_ids, "part": np.full(len(doc_ids), part),
                   "before": before + stops - sizes,
                   "ids": pa.ListArray.from_arrays(np.append(0, stops).astype(np.int32), ids)}
            before += int(stops[-1])
    ordered = docs.select("doc_id", whole_text()).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    (through_arrow(ordered, encode, SCHEMA, keeps=vocabulary).write.option("compression", "zstd")
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.create.index", "true").option("orc.row.index.stride", str(stride))
     .option("orc.stripe.size", str(stripe_mb << 20)).orc(path))


def read_tokens(spark: SparkSession, path: str, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """The rows of the files; with ``doc_ids`` those documents only, others skipped by metadata."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(*doc_ids))


def token_index(files: DataFrame) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    def digest(batches):
        for batch in batches:
            lists = batch.column("ids")
            at = lists.offsets.to_numpy()
            data = lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            yield {"doc_id": batch.column("doc_id"), "part": batch.column("part"),
                   "before": batch.column("before"), "n_tokens": np.diff(at),
                   "ids_crc32": [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(at[:-1], at[1:])]}
    rows = settle(through_arrow(
        files, digest, "doc_id long, part int, before long, n_tokens long, ids_crc32 long"), "index")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    return rows.join(parts, "part").select(
        "doc_id", (F.col("ahead") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
