import glob
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow.orc
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codeq.llm.sharding import _split, shard, write_shards
from codeq.llm.subwords import vocabulary
from codeq.llm.tokenfiles import read_tokens, token_index, write_tokens
from tests.llm.conftest import odd_texts

BYTE = vocabulary("byte_bpe_50k.json")


def test_files_come_back(make_docs, clashing, spark, tmp_path):
    rows = [(50 - i, t) for i, t in enumerate(odd_texts())] + [(None, "no id"), (7, "twice"), (7, "twice")]
    path = str(tmp_path / "tokens")
    write_tokens(make_docs(rows, **clashing), path, BYTE)
    library = Tokenizer.from_file(BYTE)
    expected = defaultdict(list)
    for doc_id, text in rows:
        expected[doc_id].append([*library.encode(text or "", add_special_tokens=False).ids, 0])
    found = read_tokens(spark, path).collect()
    assert {k: sorted(v) for k, v in expected.items()} == {
        k: sorted(r["ids"] for r in found if r["doc_id"] == k) for k in expected}
    at = 0
    for r in sorted(token_index(read_tokens(spark, path)).collect(), key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
        assert r["ids_crc32"] in [zlib.crc32(np.array(x, dtype="<u4").tobytes()) for x in expected[r["doc_id"]]]
    order = [r["doc_id"] for r in sorted(token_index(read_tokens(spark, path)).collect(), key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda x: (x is not None, x))


def test_files_can_be_pruned(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = str(tmp_path / "tokens")
    write_tokens(docs, path, BYTE, stripe_mb=1)
    few = read_tokens(spark, path, [3, 700])
    assert "PushedFilters: [In(doc_id, [3,700])]" in few._jdf.queryExecution().toString()
    assert {r["doc_id"] for r in few.collect()} == {3, 700}
    files = [pyarrow.orc.ORCFile(f) for f in glob.glob(f"{path}/*.orc")]
    assert sum(f.nrows for f in files) == docs.count()
    assert all(f.row_index_stride == 1000 for f in files)


def test_no_files_of_no_documents(make_docs, spark, tmp_path):
    write_tokens(make_docs([]), str(tmp_path / "none"), BYTE)
    assert token_index(read_tokens(spark, str(tmp_path / "none"))).count() == 0


def check_shards(rows, shards, slack):
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(sizes) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / shards
    assert all(abs(sizes[k] - mean) <= slack for k in range(shards))


def test_shards_are_even(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = shard(docs).collect()
    assert len(rows) == 1000
    check_shards(rows, 16, 2000)
    assert all(r["size"] == len(r["text"].encode()) + 1 for r in rows)


def test_equal_texts_stay_together(spark, make_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    shards_of = defaultdict(set)
    for r in shard(docs).collect():
        shards_of[r["text"] or ""].add(r["shard"])
    assert max(map(len, shards_of.values())) == 1
    rows = [(i, f"group {i % 300} of few rows " * (i % 300 % 7 + 1)) for i in range(900)] + [(2000, None), (2001, "")]
    found = shard(make_docs(rows), 3).collect()
    assert len({(r["text"] or "", r["shard"]) for r in found}) == 301
    check_shards(found, 3, 2000)


def test_groups_are_dealt_whole_where_there_is_room():
    rows = pd.DataFrame({"key": [1, 1, 1, 2, 3, 3, 4], "salt": range(7), "size": [5, 5, 5, 12, 4, 4, 1]})
    found = _split(rows, [20, 16], over=3)
    assert [len(set(found[rows["key"] == k])) for k in (1, 2, 3, 4)] == [1, 1, 1, 1]
    assert abs(sum(rows["size"][found == 0]) - 20) <= 4
    hot = pd.DataFrame({"key": [1] * 50, "salt": range(50), "size": [3] * 50})
    assert np.bincount(_split(hot, [90, 60])).tolist() == [30, 20]


def test_a_hot_text_is_split(make_docs, spark, tmp_path):
    rows = [(i, f"text number {i} " * (i % 7 + 1)) for i in range(400)] + [(1000 + i, "hot " * 20) for i in range(700)]
    sharded = shard(make_docs(rows, extra="shard string, slot double, row_range int", values=("x", 1.5, 3)), 5)
    found = sharded.collect()
    check_shards(found, 5, 100)
    assert {r["row_range"] for r in found} == {3}
    write_shards(sharded, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.groupBy("shard").agg(F.count("*").alias("n"), (F.max("slot") + 1).alias("m")).filter("n != m").count() == 0
    assert back.count() == 1100


def test_odd_rows(make_docs, clashing):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(None, None), (None, None), (2, "a"), (2, "a")]
    found = shard(make_docs(rows, **clashing), with_text=False).collect()
    assert len(found) == len(rows)
    check_shards(found, 16, 60000)
    assert sum(r["size"] for r in found) == sum(len((t or "").encode()) + 1 for _, t in rows)
    assert shard(make_docs([])).count() == 0
