import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from codeq.llm.packing import RoomTree, best_fit, packed_pieces, sequences
from codeq.llm.subwords import vocabulary
from tests.llm.conftest import odd_texts

WORD = vocabulary("word_bpe_49k.json")


def one_by_one(histogram, size):
    """Best-fit decreasing with a list of bins, piece by piece."""
    rooms = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [i for i, r in enumerate(rooms) if r >= length]
            if fits:
                i = min(fits, key=lambda i: rooms[i])
                rooms[i] -= length
            else:
                rooms.append(size - length)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_runs_pack_like_single_pieces(seed):
    rng, size = random.Random(seed), 64
    histogram = {n: rng.randrange(1, 40) for n in rng.sample(range(1, size + 1), rng.randrange(1, 50))}
    runs, bins = best_fit(histogram, size)
    used = [0] * bins
    for length, first, first_bin, per_bin, offset in runs.tolist():
        later = [r[1] for r in runs.tolist() if r[0] == length and r[1] > first]
        for place in range(first, min(later, default=histogram[length])):
            nth = place - first
            at = offset + nth % per_bin * length
            assert used[first_bin + nth // per_bin] == at
            used[first_bin + nth // per_bin] += length
    assert max(used) <= size
    assert sorted(size - u for u in used) == one_by_one(histogram, size)


def test_room_tree_finds_the_tightest():
    tree, rng, rooms = RoomTree(100), random.Random(2), set()
    for _ in range(500):
        room = rng.randrange(101)
        tree.mark(room, room not in rooms)
        rooms ^= {room}
        least = rng.randrange(101)
        assert tree.tightest(least) == min((r for r in rooms if r >= least), default=None)


def check(rows, docs, size):
    library = Tokenizer.from_file(WORD)
    expected = []
    for doc_id, text in docs:
        coded = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(coded), size)):
            part = np.array(coded[at:at + size], dtype="<u4").tobytes()
            expected.append((doc_id, piece, at, len(part) // 4, zlib.crc32(part)))
    key = lambda r: (r[0] is not None, r)
    assert sorted((tuple(r[:5]) for r in rows), key=key) == sorted(expected, key=key)
    placed = {}
    for r in rows:
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in placed.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size


def test_packing_of_odd_documents(make_docs, clashing):
    docs = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "null id"), (3, "\n"), (3, "\n")]
    packed = packed_pieces(make_docs(docs, **clashing), WORD, size=100)
    rows = packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()
    check(rows, docs, 100)
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in sequences(packed).collect()}
    for r in packed.collect():
        at = 4 * r["offset"]
        assert whole[r["sequence_id"]][at:at + 4 * r["length"]] == bytes(r["ids"])


def test_packing_of_no_documents(make_docs):
    assert packed_pieces(make_docs([]), WORD).count() == 0


def test_packing_takes_few_sequences(spark):
    from codeq.llm.queries import QUERIES
    rows = QUERIES["op5_best_fit_packing"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    check(rows, docs, 2048)
    least = -(-sum(r["length"] for r in rows) // 2048)
    assert len({r["sequence_id"] for r in rows}) <= 1.02 * least + 1
