import random
import time
from collections import defaultdict
from pathlib import Path

import pytest
import xxhash

from codeq.llm import simhash
from codeq.llm.common import recorded, settle
from codeq.llm.components import components
from codeq.llm.simhash import fingerprint, hamming_links, near_duplicates, one_of_each
from tests.llm.conftest import odd_texts


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    """Least node reachable from each, by plain search."""
    near = defaultdict(set)
    for a, b in linked:
        near[a].add(b)
        near[b].add(a)
    root = {}
    for node in sorted(nodes):
        stack = [node]
        while stack:
            x = stack.pop()
            if x not in root:
                root[x] = node
                stack.extend(near[x])
    return root


def test_fingerprints():
    for text in odd_texts():
        assert fingerprint(text or "") == plain_fingerprint(text)


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    pairs += [(1000, 1000 + i) for i in range(50)] + [(2000 + i, 2001 + i) for i in range(60)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {(a, b) for a, b in pairs if a != b}
    assert found == roots({x for p in linked for x in p}, linked)


def test_few_tables_for_components(spark):
    """Links that lead to roots already are seen to after one turn and a half; equal links change nothing."""
    pairs = [(hub, hub + i) for hub in range(0, 1000, 50) for i in range(1, 50)] * 3
    pairs += [(b, a) for a, b in pairs]
    with recorded(written := []):
        found = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {i: i // 50 * 50 for i in range(1000)}
    assert len(written) <= 7


def crowd(rng):
    """Fingerprints at random, some a few bits apart, and many around one."""
    base = [rng.getrandbits(64) for _ in range(60)]
    out = set(base)
    for f in base[:30]:
        for _ in range(4):
            out.add(f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))))
    for _ in range(400):
        out.add(base[0] ^ sum(1 << b for b in rng.sample(range(12), rng.randrange(0, 5))))
    return sorted(out)


def signed(f):
    return f - (1 << 64) if f >> 63 else f


@pytest.mark.parametrize("radius, share", [(0, 64), (1, 64), (2, 64), (2, 2), (1, 2), (2, 0)])
def test_links_connect_what_is_within_the_radius(spark, tmp_path, monkeypatch, radius, share):
    monkeypatch.setattr(simhash, "SHARE", share)
    prints = crowd(random.Random(7))
    path = str(tmp_path / "prints")
    spark.createDataFrame([(signed(f),) for f in prints], "fp long").write.parquet(path)
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64))
             for r in hamming_links(spark.read.parquet(path), radius).collect()]
    assert all(0 < (a ^ b).bit_count() <= radius for a, b in links)
    pairs = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1:] if (a ^ b).bit_count() <= radius]
    assert roots(prints, links) == roots(prints, pairs)


def test_unequal_thresholds_find_the_same(spark, tmp_path, monkeypatch):
    prints = crowd(random.Random(8))
    path = str(tmp_path / "prints")
    spark.createDataFrame([(signed(f),) for f in prints], "fp long").write.parquet(path)
    pairs = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1:] if (a ^ b).bit_count() <= 2]
    for plan in ([(0, list(range(20)), 1), (1, list(range(20, 64)), 0)], [(0, list(range(64)), 2)],
                 [(k, list(range(16 * k, 16 * k + 16)), 0) for k in (0, 2, 3)]):
        monkeypatch.setattr(simhash, "thresholds", lambda fps, radius, plan=plan: plan)
        links = [(r["a"] % (1 << 64), r["b"] % (1 << 64))
                 for r in hamming_links(spark.read.parquet(path), 2).collect()]
        assert roots(prints, links) == roots(prints, pairs)


def test_thresholds_share_out_the_distance(spark, tmp_path):
    path = str(tmp_path / "prints")
    spark.createDataFrame([(signed(f),) for f in crowd(random.Random(9))], "fp long").write.parquet(path)
    plan = simhash.thresholds(spark.read.parquet(path), 2)
    assert sum(t + 1 for _, _, t in plan) == 3
    bits = [b for _, own, _ in plan for b in own]
    assert len(bits) == len(set(bits))
    assert simhash._allocate([[0, 5, 9], [0, 1, 9], [0, 1, 2]], 3) == (3, [0, 1, 2])


def expected(docs):
    prints = [plain_fingerprint(t) for _, t in docs]
    nodes = sorted(set(prints))
    root = roots(nodes, [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1:] if (a ^ b).bit_count() <= 2])
    least = {}
    for (doc_id, _), f in zip(docs, prints, strict=True):
        if doc_id is not None:
            least[root[f]] = min(doc_id, least.get(root[f], doc_id))
    return sorted(((doc_id, f"{f:016x}", least.get(root[f])) for (doc_id, _), f in zip(docs, prints, strict=True)),
                  key=str)


def test_documents_of_the_small_table(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
            .select("doc_id", "text").collect()]
    from codeq.llm.queries import QUERIES
    found = QUERIES["op10_simhash_near_dedup"](spark, "/root/testdata/sf0.01").collect()
    assert sorted((tuple(r) for r in found), key=str) == expected(docs)


def test_odd_documents(make_docs, clashing):
    docs = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "alone here"), (None, ""), (3, "\n"), (3, "\n")]
    frame = make_docs(docs, **clashing)
    assert sorted((tuple(r) for r in near_duplicates(frame).collect()), key=str) == expected(docs)
    kept = one_of_each(frame)
    assert kept.schema.names == frame.schema.names
    groups = {(c or f) for _, f, c in expected(docs)}
    assert kept.count() == len(groups)


def test_no_documents(make_docs):
    assert near_duplicates(make_docs([])).count() == 0
    assert one_of_each(make_docs([])).count() == 0


def test_what_was_shuffled_leaves_the_disk(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {f for d in manager.localDirs() for f in Path(str(d)).rglob("shuffle_*.data")}
    before = shuffled()
    settle(spark.range(1, 6).repartition("id"), "links")
    last = time.monotonic() + 10
    while shuffled() - before and time.monotonic() < last:  # they go a moment later
        time.sleep(0.1)
    assert not shuffled() - before
