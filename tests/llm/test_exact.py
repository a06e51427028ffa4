import hashlib
import random
from collections import Counter, defaultdict

from codeq.llm.exact import Trie, distinct_texts, owners
from tests.llm.conftest import odd_texts


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known, default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return Counter(out), len(groups)


def test_trie_keeps_every_key_apart():
    rng = random.Random(1)
    keys = ["".join(rng.choice("ab") for _ in range(rng.randrange(12))).encode() for _ in range(800)]
    trie = Trie()
    for key in keys:
        node = trie.place(key)
        node.entry = (node.entry or 0) + 1
    assert dict(trie.spill()) == Counter(keys)
    assert list(trie.spill()) == []


def test_trie_spills_by_subtree():
    trie = Trie()
    for key in (b"ab", b"abc", b"ba", b"b"):
        trie.place(key).entry = key
    assert sorted(trie.spill(b"b"[0])) == [(b"b", b"b"), (b"ba", b"ba")]
    assert sorted(trie.spill()) == [(b"ab", b"ab"), (b"abc", b"abc")]


def rows_of_all_kinds():
    texts = odd_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts[:9])]
    rows += [(None, "null id"), (None, "null id"), (None, "a\n b\n"), (5, "a\n b\n"), (5, "a\n b\n")]
    rows += [(200 + i, "copy " * 50) for i in range(60)]
    return rows


def test_owners(make_docs, clashing):
    rows = rows_of_all_kinds()
    for budget in (64 << 20, 2000):  # the second one spills all the time
        found = owners(make_docs(rows, **clashing), budget).collect()
        counts, texts = expected(rows)
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == counts
        assert sum(r["kept"] for r in found) == texts
        assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])


def test_distinct_texts_keeps_whole_rows(make_docs, clashing):
    rows = rows_of_all_kinds()
    docs = make_docs(rows, **clashing)
    found = distinct_texts(docs, 2000)
    assert found.schema.names == docs.schema.names
    best = {}
    for doc_id, text in rows:
        key = text or ""
        if key not in best or (doc_id is not None and (best[key] is None or doc_id > best[key])):
            best[key] = doc_id
    assert {r["text"]: r["doc_id"] for r in found.collect()} == best
    assert {tuple(r)[5:] for r in found.collect()} == {clashing["values"]}


def test_no_documents(make_docs):
    assert owners(make_docs([])).count() == 0
    assert distinct_texts(make_docs([])).count() == 0
