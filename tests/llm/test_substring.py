import random

import numpy as np
import pytest

from codeq.llm import common, substring
from codeq.llm.substring import (
    K, LONG, LONG_WINDOW, WINDOW, Linker, PrefixBest, align, chain, drop_passages, minimizers, passages, seeds_of,
    _rising, _scored, without, word_hashes)
from tests.llm.conftest import odd_texts

RNG = random.Random(11)
WORDS = [f"w{i}" for i in range(4000)]


def prose(n, rng=RNG):
    return [rng.choice(WORDS) for _ in range(n)]


def test_minimizers_of_common_runs_are_common():
    rng = random.Random(1)
    for _ in range(30):
        run = [w.encode() for w in prose(K + WINDOW - 1, rng)]
        texts = [[w.encode() for w in prose(rng.randrange(40), rng)] + run +
                 [w.encode() for w in prose(rng.randrange(40), rng)] for _ in range(2)]
        found = [set(minimizers(t)[0].tolist()) for t in texts]
        assert found[0] & found[1]


@pytest.mark.parametrize("k, window", [(K, WINDOW), (LONG, LONG_WINDOW)])
def test_minimizers_are_the_least_of_their_windows(k, window):
    rng = random.Random(4)
    for _ in range(150):
        words = [b"w%d" % rng.randrange(60) for _ in range(rng.randrange(80))]
        hashes, places = minimizers(words, k, window)
        runs = {}
        for at in range(len(words) - k + 1):  # each run by itself, so equal runs are equal hashes
            runs[at] = int(minimizers(words[at:at + k], k, 1)[0][0]) % 2**64
        views = [range(at, at + window) for at in range(len(runs) - window + 1)] or ([range(len(runs))] if runs else [])
        want = {p for v in views for p in v if runs[p] == min(runs[q] for q in v)}
        if 0 < len(runs) < window:
            want = {min(runs, key=lambda p: (runs[p], p))}
        assert set(places.tolist()) == want
        assert [h % 2**64 for h in hashes.tolist()] == [runs[p] for p in places.tolist()]


def test_seeds_do_not_depend_on_their_neighbours(monkeypatch):
    texts = [(t or "").encode() for t in odd_texts()] + [" ".join(prose(n)).encode() for n in (3, 8, 26, 300)]
    apart = [[x.tolist() for x in seeds_of([t])[:2]] for t in texts]
    for size in (substring.BYTES, 7):
        monkeypatch.setattr(substring, "BYTES", size)
        seeds, places, of = seeds_of(texts)
        for i, (own, at) in enumerate(apart):
            assert sorted(zip(own, at)) == sorted(zip(seeds[of == i].tolist(), places[of == i].tolist()))
    assert [int(n) for n in np.diff(word_hashes(texts)[1])] == [len(t.lower().split()) for t in texts]


def test_links_to_the_first_and_the_document_before():
    rng = random.Random(6)
    for _ in range(60):
        rows = sorted({(rng.randrange(4), rng.randrange(6), rng.randrange(5)) for _ in range(60)})
        places, want = {}, []
        for seed, key, pos in rows:
            places.setdefault(seed, {}).setdefault(key, []).append(pos)
        for own in places.values():
            keys = sorted(own)
            for i, key in enumerate(keys[1:], 1):
                for other in {keys[0], keys[i - 1]}:
                    want += [(key, other, pos, own[other][0]) for pos in own[key]]
        linker, got = Linker(), []
        while rows:
            n = rng.randrange(1, 9)
            out = linker.links(*np.array(rows[:n], dtype=np.int64).T)
            got += zip(*(out[c].tolist() for c in ("key", "owner", "pos", "owner_pos")))
            rows = rows[n:]
        assert sorted(got) == sorted(want)


def test_straight_chains_hold_those_of_the_tree():
    rng = random.Random(8)
    for _ in range(100):
        pos = sorted(rng.sample(range(400), rng.randrange(2, 40)))
        straight = chain(pos, [x + 9 for x in pos])
        # a link far off the diagonal makes it use the tree and joins nothing
        tree = chain([*pos, 10_000], [*(x + 9 for x in pos), 5])
        assert all(any(set(t) <= set(c) for c in straight) for t in tree)
        assert all(pos[b] - pos[a] <= substring.MAX_GAP for c in straight for a, b in zip(c, c[1:]))


def test_rising_links_have_the_scores_of_the_tree():
    rng, told = random.Random(8), 0
    for _ in range(500):
        steps = [(rng.choice([1, 2, 3, 9, 40, 70]), rng.choice([1, 2, 3, 9, 40, 70])) for _ in range(rng.randint(2, 30))]
        pos, owner_pos = ([sum(s[i] for s in steps[:n + 1]) for n in range(len(steps))] for i in (0, 1))
        found = _rising(pos, owner_pos, 5)
        told += found is not None
        assert found in (None, _scored(pos, owner_pos, 5))
        assert _rising([*pos, pos[-1]], [*owner_pos, owner_pos[-1] + 1], 5) is None
    assert told > 400


def test_links_in_any_order_and_told_twice(spark, monkeypatch):
    """A document's links may come in any order and over several batches."""
    rng = random.Random(9)
    links = [(key, owner, x, x + owner) for key in range(1, 6) for owner in range(key) for x in range(0, 900, 3 + owner)]
    rows = links + rng.sample(links, 500)
    rng.shuffle(rows)
    schema = "key long, owner long, pos int, owner_pos int"
    found = substring._chains(spark.createDataFrame(rows, schema)).collect()
    monkeypatch.setattr(substring, "larger_batches", lambda spark: common.larger_batches(spark, 7))
    assert sorted(found) == sorted(substring._chains(spark.createDataFrame(rows, schema)).collect())
    assert {(r["key"], r["owner"]) for r in found} == {(key, 0) for key in range(1, 6)}
    assert all(list(r["pos"]) == list(range(0, 900, 3)) and r["pos"] == r["owner_pos"] for r in found)


def test_prefix_best():
    rng, tree, values = random.Random(2), PrefixBest(50), {}
    for i in range(300):
        place, value = rng.randrange(50), rng.random()
        tree.put(place, value, i)
        values[place] = max(values.get(place, (-1, -1)), (value, i))
        before = rng.randrange(51)
        best = max((v for p, v in values.items() if p < before), default=(-1e18, -1))
        assert tree.before(before) == best


def test_chains_rise_on_both_sides():
    rng = random.Random(3)
    points = sorted({(rng.randrange(300), rng.randrange(300)) for _ in range(200)})
    x, y = [p[0] for p in points], [p[1] for p in points]
    used = set()
    for links in chain(x, y):
        assert len(links) > 1 and not used & set(links)
        used |= set(links)
        assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(links, links[1:]))


def test_alignment_ends_where_the_likeness_does():
    run = prose(60)
    changed = run[:20] + ["other"] + run[21:40] + run[41:]
    a = [w.encode() for w in prose(30) + run + prose(30)]
    b = [w.encode() for w in prose(10) + changed + prose(30)]
    (x1, x2, y1, y2, equal), = align(a, b, [30, 40, 80], [10, 20, 59])
    assert (x1, x2, y1, y2, equal) == (30, 90, 10, 69, 58)


def changed(run, alike, rng, shifts=False):
    """The run with other words at random places, so that it is this much alike."""
    out = list(run)
    for at in sorted(rng.sample(range(1, len(run) - 1), round(len(run) * (1 - alike))), reverse=True):
        kind = rng.random() if shifts else 1
        if kind < 0.15:
            del out[at]
        elif kind < 0.3:
            out.insert(at, f"new{rng.random()}")
        else:
            out[at] = f"new{rng.random()}"
    return out


def test_likeness_is_that_of_the_whole_span():
    run = [w.encode() for w in prose(91)]
    other = run[:40] + [b"x%d" % i for i in range(11)] + run[51:]
    pos = list(range(0, 36, 5)) + list(range(51, 87, 5))
    assert align(run, other, pos, pos) == [(0, 91, 0, 91, 80)]
    far = run[:80] + [b"x%d" % i for i in range(8)] + run[88:]  # three equal words don't pay for eight others
    assert [p[:2] for p in align(run, far, pos[:8], pos[:8])] == [(0, 80)]


def test_a_short_best_piece_does_not_end_the_search():
    run = [w.encode() for w in prose(60)]
    other = [w if i % 5 != 4 else b"other" for i, w in enumerate(run)]  # 0.8 alike, never five words running
    assert [p[1] - p[0] >= 55 for p in align(run, other, [0, 5], [0, 5])] == [True]


@pytest.mark.parametrize("alike", [0.8, 0.85, 0.9])
def test_aligned_passages_are_as_long_as_they_are_alike(alike):
    rng, found = random.Random(51), 0
    for _ in range(100):
        run = prose(60, rng)
        a, b = ([w.encode() for w in prose(70, rng) + r + prose(70, rng)] for r in (changed(run, alike, rng), run))
        links = [i for i in range(70, 126) if a[i:i + K] == b[i:i + K]]
        pieces = align(a, b, links, links) if len(links) > 1 else []
        assert all(5 * e >= 4 * max(x2 - x1, y2 - y1) for x1, x2, y1, y2, e in pieces)
        found += any(x2 - x1 >= 50 for x1, x2, *_ in pieces)
    assert found >= 95


@pytest.mark.parametrize("shifts", [False, True])
@pytest.mark.parametrize("alike, least", [(0.8, 90), (0.85, 97), (0.9, 99)])
def test_fuzzy_passages_have_seeds_enough(alike, least, shifts):
    """All of two texts, from the words to the pieces; 100 passages of 60 words."""
    rng, found = random.Random(71), 0
    for _ in range(100):
        run = prose(60, rng)
        a, b = ([w.encode() for w in prose(70, rng) + r + prose(70, rng)]
                for r in (changed(run, alike, rng, shifts), run))
        seeds = [dict(zip(*(x.tolist() for x in minimizers(t)))) for t in (a, b)]
        links = sorted((p, seeds[1][h]) for h, p in seeds[0].items() if h in seeds[1])
        pos, owner_pos = [x for x, _ in links], [y for _, y in links]
        found += any(p[1] - p[0] >= 50 for c in chain(pos, owner_pos)
                     for p in align(a, b, [pos[i] for i in c], [owner_pos[i] for i in c]))
    assert found >= least


def test_a_dropped_word_behind_the_last_seed_ends_nothing():
    run = [w.encode() for w in prose(60)]
    (x1, x2, y1, y2, equal), = align(run, run[:45] + run[46:], [0, 5], [0, 5])
    assert (x1, x2, y1, y2, equal) == (0, 60, 0, 59, 59)


def rows_of(docs, frame):
    return sorted((r["doc_id"], r["start_word"], r["end_word"], r["other_id"]) for r in passages(frame).collect())


def common_windows(a, b, size):
    windows = [{tuple(x[i:i + size]) for i in range(len(x) - size + 1)} for x in (a, b)]
    return windows[0] & windows[1]


def planted():
    rng = random.Random(21)
    shared, other = prose(55, rng), prose(80, rng)
    fuzzy = list(other)
    fuzzy[10], fuzzy[40] = "x", "y"
    del fuzzy[60]
    docs = [prose(200, rng) for _ in range(8)]
    docs[1][50:50] = shared
    docs[3][0:0] = shared
    docs[5] += shared
    docs[2][20:20] = other
    docs[6][100:100] = fuzzy
    docs[7] = docs[4][:40] + docs[7]  # too short to count
    return [" ".join(d) for d in docs]


def test_planted_passages(make_docs, clashing):
    texts = planted()
    frame = make_docs(list(enumerate(texts)), parts=1, **clashing)
    found = rows_of(texts, frame)
    # make_docs deals rows out anew, so which one counts as the first may be any of them.
    pairs = {frozenset((a, b)) for a, _, _, b in found}
    groups = [{1, 3, 5}, {2, 6}]
    assert all(any(p <= g for g in groups) for p in pairs)
    assert len(pairs) == 3
    for doc_id, start, stop, _ in found:
        assert stop - start >= (55 if doc_id in groups[0] else 79)
    kept = {r["doc_id"]: r["text"] for r in drop_passages(frame).collect()}
    assert sorted(kept) == list(range(8))
    assert kept[0] == texts[0] and kept[4] == texts[4] and kept[7] == texts[7]
    left = [kept[i].split() for i in range(8)]
    assert not any(common_windows(left[i], left[j], 50) for i in range(8) for j in range(i))


def test_every_long_common_run_is_found(spark):
    """Brute force over the small table: runs of 51 words that an earlier document has are covered."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    covered = {}
    for r in passages(docs).collect():
        covered.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
        assert r["similarity"] >= 0.8 and r["doc_id"] > r["other_id"]
    seen, missed, again = {}, 0, 0
    for r in docs.collect():
        words = r["text"].encode().lower().split()
        if len(set(words)) * 5 < len(words):
            continue  # the same few words over and over
        for at in range(len(words) - 50):
            if seen.setdefault(b" ".join(words[at:at + 51]), r["doc_id"]) != r["doc_id"]:
                again += 1
                missed += len(covered.get(r["doc_id"], set()) & set(range(at, at + 51))) < 46
    assert again > 1000 and missed <= 0.01 * again


def test_parts_from_several_documents_are_one_passage(make_docs):
    rng = random.Random(31)
    a, b = prose(30, rng), prose(30, rng)
    rows = [(0, " ".join(prose(50, rng) + a)), (1, " ".join(prose(50, rng) + b)), (2, " ".join(a + b))]
    frame = make_docs(rows).coalesce(1).orderBy("doc_id")
    assert [(r["doc_id"], r["start_word"], r["end_word"]) for r in passages(frame).collect()] == [(2, 0, 60)]


def test_earlier_owners_of_short_seeds_hide_no_passage(make_docs):
    """Every five words of the passage are also in an earlier document of their own."""
    rng = random.Random(61)
    run = prose(60, rng)
    texts = [" ".join(prose(20, rng) + run[i:i + 5] + prose(20, rng)) for i in range(56)]
    texts += [" ".join(prose(30, rng) + run + prose(30, rng)) for _ in range(2)]
    frame = make_docs(list(enumerate(texts))).coalesce(1).orderBy("doc_id")
    assert [(r["doc_id"], r["start_word"], r["end_word"], r["other_id"])
            for r in passages(frame).collect()] == [(57, 30, 90, 56)]


@pytest.mark.parametrize("alike", [0.8, 0.85])
def test_fuzzy_passages_are_found_where_seeds_are_owned_elsewhere(make_docs, alike):
    """Half of the five-word runs of each passage are in an earlier document of another kind."""
    rng, rows = random.Random(81), []
    pairs = [(run := prose(60, rng), changed(run, alike, rng)) for _ in range(60)]
    for a, b in pairs:
        for text in (a, b):
            rows += [prose(15, rng) + text[i:i + 5] + prose(15, rng) for i in range(56) if rng.random() < 0.5]
    first = len(rows)
    rows += [prose(40, rng) + a + prose(40, rng) for a, _ in pairs] + [prose(40, rng) + b + prose(40, rng) for _, b in pairs]
    frame = make_docs([(i, " ".join(r)) for i, r in enumerate(rows)]).coalesce(1).orderBy("doc_id")
    found = {r["doc_id"] for r in passages(frame).collect() if r["end_word"] - r["start_word"] >= 50}
    assert found <= set(range(first + 60, first + 120)) and len(found) >= 54


@pytest.mark.parametrize("circle", [1, 2, 7])
def test_texts_that_go_round_in_circles(make_docs, circle):
    rng = random.Random(41)
    round_ = " ".join(prose(circle, rng))
    texts = [" ".join(prose(30, rng)) + f" {round_}" * (80 // circle + 5 * i) + " " + " ".join(prose(30, rng))
             for i in range(2)]
    found = passages(make_docs(list(enumerate(texts))).coalesce(1).orderBy("doc_id")).collect()
    assert [r["doc_id"] for r in found] == [1] and found[0]["end_word"] - found[0]["start_word"] >= 75


def test_text_without_spans():
    assert without(" a b  c\nd e", [(1, 3)]) == " a\nd e"
    assert without("a b c", [(0, 3)]) == ""
    assert without("a É c d", [(3, 4), (0, 1)]) == " É c"


def test_odd_documents(make_docs, clashing):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(None, " ".join(prose(70)))] * 3
    frame = make_docs(rows, **clashing)
    found = [r for r in passages(frame).collect() if r["doc_id"] is None]
    assert len(found) == 2 and all(r["end_word"] - r["start_word"] == 70 for r in found)
    kept = drop_passages(frame)
    assert kept.schema.names == frame.schema.names
    assert sum(r["doc_id"] is None for r in kept.collect()) == 1
    assert {r["doc_id"] for r in kept.collect()} >= {i for i, t in enumerate(odd_texts())}
    assert all(r["n_chars"] == len(r["text"] or "") for r in kept.collect())


@pytest.mark.parametrize("run", [passages, drop_passages])
def test_no_documents(make_docs, run):
    assert run(make_docs([])).count() == 0
