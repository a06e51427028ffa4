"""Whole texts to ids with the tokenizers library, each distinct word encoded once per worker."""

from __future__ import annotations

import os
import string
from array import array

import numpy as np

from codeq.llm.common import kept_by_worker

STOPS = ".,!?;:"
MARKS = string.punctuation.replace("'", "")  # an apostrophe may go with the letters after it
BREAK = "\n  "  # a line feed between characters that are no white space; no word is kept so
TAILS = 1 << 16


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it is visible, else the next from U+0100."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


LETTERS = {b: letter for b, letter in enumerate(byte_letters())}
SPACE = LETTERS[32]


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordEncoder:
    """Encodes texts as the library does, from ids kept by the words between single spaces.

    ``spaced``: the vocabulary keeps spaces (byte-level), a space going with the word after it. Its
    pre-tokens never run from a character that is no white space into a space, so a text may be cut
    there, and the pieces encoded apart. A line feed between two such characters is a pre-token of its own. A word that is empty or ends with other white space gives
    no such place; a text with one is encoded in one go. Without ``spaced`` white space is dropped,
    and any space is such a place. At most ``limit`` words are kept.
    """

    def __init__(self, path: str, spaced: bool, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit
        self.library = Tokenizer.from_file(path)
        self.spaced, self.limit, self.known = spaced, limit, {}
        self.stops = MARKS if spaced else STOPS  # one pre-token if they follow a letter
        self.ends = frozenset(self.stops)
        self.tails: dict[str, bytes] = {}
        self.lower = '"Lowercase"' in self.library.to_str()
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.library.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.edge[[i for t, i in vocabulary.items()
                   if (t.startswith(SPACE) if spaced else t.endswith("</w>"))]] = True

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in
                self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _keys(self, text: str) -> list[str]:
        if not self.spaced and "<|" not in text:
            text = text.replace("\n", " ")
            if self.lower and _latin(text):
                text = text.lower()  # as the vocabulary does; other letters may depend on their context
        if self.spaced and "\n" in text:
            lines = text.split("\n")
            if all(line and not line[0].isspace() and not line[-1].isspace() for line in lines):
                words = []
                for line in lines:
                    at = len(words)
                    words += line.split(" ")
                    words[at] += " "
                    words.append(BREAK)
                return words[:-1]
        words = text.split(" ")
        if self.spaced:
            words[0] += " "  # no other word ends so: the first of a line has no space before it
        return words

    def _bare(self, words: list[str]) -> list[bytes]:
        """Ids of words of lower-case Latin-1 letters (any case, with a space before, if spaced).

        Normalising and pre-tokenising leave such a word as it is, so its bytes go to the library's
        model as they are; ids that begin a word, or end one, tell where the next one begins.
        """
        letters = [w if w.isascii() else w.encode().decode("latin-1").translate(LETTERS) for w in words]
        joined = " ".join([f"{SPACE}{w}" for w in letters] if self.spaced else letters)
        ids = np.array(self.model.encode_batch_fast([joined], add_special_tokens=False)[0].ids,
                       dtype="<u4")
        edges = np.flatnonzero(self.edge[ids])
        if len(edges) != len(words):
            raise ValueError("words can't be told apart by their ids")
        at = [*(4 * edges).tolist(), 4 * len(ids)] if self.spaced else [0, *(4 * edges + 4).tolist()]
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(at, at[1:])]

    def _learn(self, words: list[str]) -> dict[str, bytes | None]:
        """Ids of new words, None for those after which a text can't be cut."""
        bare = [w for w in words if w.isalpha() and (w.isascii() or max(w) < "\u0100")
                and (self.spaced or w == w.lower())]
        fresh = dict(zip(bare, self._bare(bare), strict=True)) if bare else {}
        asked = {}
        for w in words:
            if w in fresh:
                continue
            body = w.rstrip(" ") if self.spaced else w
            if w == BREAK:
                fresh[w] = self._library(["\n"])[0]
            elif self.spaced and (not body or body[-1].isspace()):
                fresh[w] = None
            else:
                asked[w] = f" {w}" if self.spaced and len(body) == len(w) else body
        fresh.update(zip(asked, self._library(list(asked.values())), strict=True))
        return fresh

    def _fresh(self, new: set[str]) -> dict[str, bytes]:
        """Ids of new words. Letters and the stops after them are pre-tokens apart, and joined here."""
        stems = {w: s for w in new if w[-1:] in self.ends and (s := w.rstrip(self.stops)).isalpha()}
        fresh = self._learn([w for w in {*stems.values(), *(new - stems.keys())} if w not in self.known])
        for w, stem in stems.items():
            tail = w[len(stem):]
            if tail not in self.tails:
                if len(self.tails) >= TAILS:
                    self.tails.clear()
                self.tails[tail] = self._library([tail])[0]
            fresh[w] = (fresh[stem] if stem in fresh else self.known[stem]) + self.tails[tail]
        return fresh

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers; texts of a few megabytes in all."""
        known, join = self.known, b"".join
        out: list[bytes | None] = []
        waiting: list[tuple[int, list[str], list]] = []
        new: set[str] = set()
        for text in texts:
            words = self._keys(text)
            ids = list(map(known.get, words))
            try:
                out.append(join(ids))
            except TypeError:  # some word is not known
                waiting.append((len(out), words, ids))
                out.append(None)
                new.update([w for w, x in zip(words, ids, strict=True) if x is None])
        fresh = self._fresh(new) if new else {}
        for at, words, ids in waiting:
            ids = [fresh[w] if x is None else x for w, x in zip(words, ids, strict=True)]
            if None in ids:  # a word after which the text can't be cut
                out[at] = self._library([texts[at]])[0] if texts[at] else b""
            else:
                out[at] = join(ids)
        if len(known) + len(fresh) <= self.limit:
            known.update(fresh)
            for w in [w for w, x in fresh.items() if x is None]:
                del known[w]
        return out


def word_encoder(path: str, spaced: bool, limit: int) -> WordEncoder:
    """The encoder of this worker, kept under its path; its words stay known from task to task."""
    return kept_by_worker(path, lambda: WordEncoder(path, spaced, limit))


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
