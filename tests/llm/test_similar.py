"""Near copies by similarity, held to brute force over all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from codeq.llm import similar
from codeq.llm.similar import _by_fingerprint, _needed, jaccard, one_of_each, prefixes, shingles
from tests.llm.conftest import odd_texts
from tests.llm.test_simhash import roots


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def left_by_brute_force(docs):
    """Least ids of the components of all pairs 0.8 alike or more."""
    sets = {i: plain_shingles(t) for i, t in docs}
    linked = [(a, b) for a in sets for b in sets if a < b and (
        not sets[a] | sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))]
    return {i for i, root in roots(sets, linked).items() if i == root}


def groups(rng, count, copies):
    words = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(count):
        base = [rng.choice(words) for _ in range(rng.randrange(60, 200))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(0, 5)):
                text[rng.randrange(len(text))] = rng.choice(words)
            out.append(" ".join(text))
    rng.shuffle(out)
    return list(enumerate(out))


def test_similarity_is_that_of_the_shingles():
    texts = [t or "" for t in odd_texts()] + ["a b c d e f g", "A b c d e f h"]
    for a in texts:
        for b in texts:
            x, y = plain_shingles(a), plain_shingles(b)
            assert jaccard(shingles(a), shingles(b)) == (len(x & y) / len(x | y) if x | y else 1)


@pytest.mark.parametrize("share", [64, 0])
def test_crowded_or_not_the_same_documents_stay(make_docs, monkeypatch, share):
    monkeypatch.setattr(similar, "SHARE", share)
    docs = groups(random.Random(5), 12, 14)
    assert {r["doc_id"] for r in one_of_each(make_docs(docs)).collect()} == left_by_brute_force(docs)


def test_the_stage_leaves_one_of_what_is_alike(spark):
    """Brute force over the table, most of whose near copies differ in more than two bits."""
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = [tuple(r) for r in frame.select("doc_id", "text").collect()]
    kept = corpus_pipeline.near_dedup(spark, frame, "").collect()
    assert {r["doc_id"] for r in kept} == left_by_brute_force(docs)


def test_odd_documents(make_docs, clashing):
    docs = [(i, t) for i, t in enumerate(odd_texts())]
    frame = make_docs(docs + [(None, "alone here"), (None, ""), (3, "\n")], **clashing)
    kept = one_of_each(frame)
    assert kept.schema.names == frame.schema.names
    assert {r["doc_id"] for r in kept.collect()} == left_by_brute_force(docs) | {None}
    assert one_of_each(make_docs([])).count() == 0


def test_alike_texts_share_a_place_where_enough_is_left():
    """Every pair that is alike, of any two lengths, meets at the first shingle both have."""
    rng = np.random.default_rng(3)
    met = 0
    for _ in range(3000):
        n = int(rng.integers(1, 120))
        a = rng.integers(1 << 62, size=n, dtype=np.uint64)
        b = np.concatenate([a[int(rng.integers(0, n // 5 + 1)):], rng.integers(1 << 62, size=rng.integers(0, n // 5 + 1), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if jaccard(a, b) < 0.8:
            continue
        met += 1
        counts = rng.integers(0, 5, size=similar.SLOTS)
        short, long = sorted((a, b), key=len)
        x, y = prefixes(short, counts, 0.8), prefixes(long, counts, 0.8)
        first = {p: at for p, at, longer in zip(*x, strict=True) if not longer}
        need = _needed(0.8, len(a), len(b))
        assert any(longer and p in first and min(len(short) - first[p], len(long) - at) >= need
                   for p, at, longer in zip(*y, strict=True))
    assert met > 1000


def test_texts_of_one_template_are_not_compared_all_with_all(make_docs, monkeypatch):
    """None is 0.8 alike but for two copies; pairs held to their texts grow with the documents."""
    proposed, real = [], similar.settle

    def settle(df, purpose):
        out = real(df, purpose)
        if purpose == "proposed":
            proposed.append(out.count())
        return out
    monkeypatch.setattr(similar, "settle", settle)
    rng = random.Random(8)
    frame = [f"t{i}" for i in range(170)]
    docs = [(i, " ".join(frame + [f"own{rng.randrange(10**9)}" for _ in range(30)])) for i in range(600)]
    docs.append((600, docs[7][1] + " and more"))
    assert {r["doc_id"] for r in one_of_each(make_docs(docs)).collect()} == set(range(600))
    assert sum(proposed) < 20 * len(docs)


def test_simhash_links_are_a_step_of_the_stage(spark, make_docs, monkeypatch):
    """Without any band the stage still links what is alike and within two bits, by the pigeonhole principle."""
    from codeq.llm.simhash import fingerprint
    docs = groups(random.Random(11), 10, 8) + [(90, "one two three"), (91, "ONE  two three"), (92, "other words")]
    monkeypatch.setattr(similar, "bands", lambda hashes: np.zeros(0, np.int64))
    sets = {i: plain_shingles(t) for i, t in docs}
    prints = {i: fingerprint(t, 5) for i, t in docs}
    linked = [(a, b) for a in sets for b in sets if a < b and (prints[a] ^ prints[b]).bit_count() <= 2
              and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert len(linked) > 10
    kept = {r["doc_id"] for r in one_of_each(make_docs(docs)).collect()}
    assert kept == {i for i, root in roots(sets, linked).items() if i == root} < set(sets)


def test_simhash_proposes_each_pair_within_the_radius(spark, tmp_path):
    rng = random.Random(12)
    base = [rng.getrandbits(62) for _ in range(20)]
    prints = [b ^ sum(1 << i for i in rng.sample(range(62), n)) for b in base for n in (0, 0, 1, 2, 6)]
    spark.createDataFrame(list(enumerate(prints)), "key long, fp long").write.parquet(str(tmp_path / "nodes"))
    pairs = [tuple(r) for r in _by_fingerprint(spark.read.parquet(str(tmp_path / "nodes"))).collect()]
    near = [(a, b) for a in range(100) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert all((prints[a] ^ prints[b]).bit_count() <= 2 for a, b in pairs)
    assert roots(range(100), pairs) == roots(range(100), near)


def test_places_where_nothing_can_meet_are_left_out(spark, make_docs):
    rng = random.Random(9)
    frame = [f"t{i}" for i in range(60)]
    docs = [(i, " ".join(frame + [f"own{rng.randrange(10**9)}" for _ in range(30)])) for i in range(40)]
    docs.append((40, docs[7][1] + " and more"))
    frame = make_docs(docs).withColumnRenamed("doc_id", "_row")
    ranked = similar._ranked(frame.selectExpr("_row AS key"), frame, "_row", 0.8, 5).collect()
    places = {}
    for r in ranked:
        places.setdefault(r["place"], []).append(r)
    assert places and all(len({r["key"] for r in p}) > 1 and len({r["longer"] for r in p}) == 2 for p in places.values())
    assert {7, 40} <= {r["key"] for r in ranked}


def test_pairs_are_held_against_all_earlier_ones_at_once(spark, make_docs, monkeypatch):
    """A join per earlier table made rows of all pairs as often as there had been turns."""
    plans, real = [], similar.settle

    def settle(df, purpose):
        plans.extend([df._jdf.queryExecution().optimizedPlan().toString()] * (purpose == "proposed"))
        return real(df, purpose)
    monkeypatch.setattr(similar, "settle", settle)
    rows = make_docs([(i, "one two three four five") for i in range(5)]).withColumnRenamed("doc_id", "_row")
    seen = []
    for b in (1, 2, 3, 4):
        pairs = spark.createDataFrame([(0, x) for x in range(1, b + 1)], "a long, b long")
        assert [tuple(r) for r in similar._alike(pairs, rows, "_row", 0.8, 5, seen).collect()] == [(0, b)]
    assert [p.count("LeftAnti") for p in plans] == [0, 1, 1, 1]
