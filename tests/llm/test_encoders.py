"""Encoders against the libraries, on odd and random texts."""

import random
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from codeq.llm.counts import RankCounter, token_counts
from codeq.llm.pieces import MARK, PieceModel, decoded, encoded
from codeq.llm.subwords import WordEncoder, vocabulary
from tests.llm.conftest import odd_texts

BYTE, WORD, PIECE = (vocabulary(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
LIBRARY = {path: Tokenizer.from_file(path) for path in (BYTE, WORD)}
PIECES = sentencepiece.SentencePieceProcessor(model_file=PIECE)
ENCODERS = {BYTE: WordEncoder(BYTE, True, limit=300), WORD: WordEncoder(WORD, False, limit=300)}
COUNTER, MODEL = RankCounter(BYTE), PieceModel(PIECE)
ALPHABET = st.sampled_from("ab eE\n\t.,'’sé中😀\x00\x1c\x85\xa0▁<|>0x1234567890endoftxÀÉςΣ́ ")
TEXTS = st.lists(st.text(ALPHABET, max_size=60), max_size=6)


def plain(texts):
    return [t or "" for t in texts]


def ids(data):
    return np.frombuffer(data, dtype="<u4").tolist()


@pytest.mark.parametrize("path", [BYTE, WORD])
@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_word_encoder_is_the_library(path, texts):
    for found, text in zip(ENCODERS[path].encode(texts), texts, strict=True):
        assert ids(found) == LIBRARY[path].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_word_encoder_on_odd_texts(path):
    texts = plain(odd_texts())
    for _ in range(2):  # new words, then known ones
        for found, text in zip(ENCODERS[path].encode(texts), texts, strict=True):
            assert ids(found) == LIBRARY[path].encode(text, add_special_tokens=False).ids


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_rank_merging_counts_like_the_library(texts):
    texts = texts + plain(odd_texts())[:6]
    assert COUNTER.counts(texts) == [
        len(LIBRARY[BYTE].encode(t, add_special_tokens=False).ids) for t in texts]


def test_rank_merging_of_long_texts():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(20000)), "a" * 10001, "ab" * 5001, *plain(odd_texts())]
    assert COUNTER.counts(texts) == [
        len(LIBRARY[BYTE].encode(t, add_special_tokens=False).ids) for t in texts]


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_pieces_are_the_librarys(texts):
    for text in texts:
        found = MODEL.encode(text)
        assert ids(found) == PIECES.encode(text)
        assert MODEL.decode(found) == PIECES.decode(PIECES.encode(text))
        if MARK not in text:
            assert MODEL.decode(found) == text


def test_pieces_of_odd_texts_as_one_stream():
    """Without the safe cuts before spaces, the window alone has to settle everything."""
    whole = PieceModel(PIECE)
    whole.cuts = False
    for text in plain(odd_texts()):
        assert ids(whole.encode(text)) == PIECES.encode(text)


def test_the_window_stays_bounded():
    seen = []

    class Watched(PieceModel):
        def _step(self, window, *rest):
            seen.append(len(window))
            super()._step(window, *rest)
    model = Watched(PIECE)
    assert "".join(model.segment("no▁spaces▁here" * 5000)) == "no▁spaces▁here" * 5000
    assert max(seen) <= 6 * model.longest


def test_unigram_scores_give_the_best_sum():
    """The same lattice with additive scores, against a search over the whole text."""
    model, rng = PieceModel(PIECE, merges=False), random.Random(9)
    model.score = {p: -rng.random() * 5 - 1 for p in ["a", "b", "ab", "ba", "aab", "bb", "abab", "c", "cab"]}
    model.longest = 4
    for _ in range(60):
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 60)))
        best = [0.0]
        for end in range(1, len(text) + 1):
            best.append(max(best[s] + model.score[text[s:end]] for s in range(max(0, end - 4), end)
                            if text[s:end] in model.score))
        pieces = list(model.segment(text))
        assert "".join(pieces) == text
        assert sum(model.score[p] for p in pieces) == pytest.approx(best[-1])


ROWS = [(50 - i, t) for i, t in enumerate(odd_texts())] + [(None, "no id"), (7, "twice"), (7, "twice"), (60, "w " * 512)]


def by_repr(rows):
    return sorted(rows, key=repr)


def test_counts_per_document(make_docs, clashing):
    extra = {"extra": f"n_tokens string, n_bytes string, {clashing['extra']}", "values": ("x", "y", *clashing["values"])}
    found = token_counts(make_docs(ROWS, **extra), BYTE).collect()
    expected = []
    for doc_id, text in ROWS:
        n = len(LIBRARY[BYTE].encode(text or "", add_special_tokens=False).ids)
        expected.append((doc_id, len((text or "").encode()), n, n > 512))
    assert by_repr(map(tuple, found)) == by_repr(expected)
    assert {r["over_limit"] for r in found} == {True, False}
    assert token_counts(make_docs([]), BYTE).collect() == []


def test_pieces_per_document(make_docs, clashing):
    extra = {"extra": f"ids string, n_tokens string, {clashing['extra']}", "values": ("x", "y", *clashing["values"])}
    frame = encoded(make_docs(ROWS, **extra), PIECE)
    expected = []
    for doc_id, text in ROWS:
        own = np.array(PIECES.encode(text or ""), dtype="<u4").tobytes()
        expected.append((doc_id, len(own) // 4, zlib.crc32(own), MARK not in (text or ""), own))
    assert by_repr((r[0], r[1], r[2], r[3], bytes(r[4])) for r in frame.collect()) == by_repr(expected)
    back = decoded(frame, PIECE).collect()
    assert by_repr(map(tuple, back)) == by_repr((i, (t or "").replace(MARK, " ")) for i, t in ROWS)
    without = encoded(make_docs(ROWS), PIECE, with_ids=False)
    assert {r["ids"] for r in without.collect()} == {None}
    assert {r["text"] for r in decoded(without, PIECE).collect()} == {None}
    assert encoded(make_docs([]), PIECE).collect() == []


def test_a_text_of_two_million_characters(make_docs):
    rows = [(1, "a long text, said over and over again. " * 50_000), (2, "x" * 300_000)]
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts(make_docs(rows), BYTE).collect()}
    pieces = {r["doc_id"]: (r["n_tokens"], r["round_trip"]) for r in encoded(make_docs(rows), PIECE).collect()}
    for doc_id, text in rows:
        assert counts[doc_id] == len(LIBRARY[BYTE].encode(text, add_special_tokens=False).ids)
        assert pieces[doc_id] == (len(PIECES.encode(text)), True)


def test_words_around_line_feeds_and_before_marks_stay_known(monkeypatch):
    """Pairs of words around a line feed are nearly as many as there are lines; the words are few."""
    encoder = WordEncoder(BYTE, True)
    encoder.encode(["alpha beta.\ngamma delta$$$ end\nend"])
    texts, library = ["alpha delta.\ngamma beta$$$ end\ngamma"], Tokenizer.from_file(BYTE)
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(encoder, "_library", lambda texts: pytest.fail(f"asked for {texts}") if texts else [])
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in encoder.encode(texts)] == expected


def test_white_space_beside_line_feeds_is_left_to_the_library():
    parts = ["a", "b's", "É", "\n", "\n\n", " ", "  ", "\n ", " \n", "\t", "$", "'", "_", "1", ".", "<|endoftext|>", " "]
    rng, encoder, library = random.Random(4), WordEncoder(BYTE, True), Tokenizer.from_file(BYTE)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in encoder.encode(texts)] == expected
