"""SentencePiece encoding and decoding with a streaming lattice.

The lattice has a node behind every character and one backpointer at each: to where the last piece
of the best segmentation of the text so far begins. Only the backpointers of the last characters, as
many as the longest piece has, can still be followed by what comes; when all of them lead back over
one boundary, the pieces before it are settled and leave the window.

For a model of merges (type BPE) the best segmentation is the one that merging yields. A sequence of
pieces is that one if and only if merging leaves each neighbouring pair as it is, so each node has
exactly one backpointer: to the node whose own last piece goes with the new piece. For a unigram
model it is the one with the greatest sum of scores.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame

from codeq.llm.common import chunks, kept_by_worker, through_arrow, whole_text

MARK = "▁"
KNOWN_UNITS = 500_000
STOPS = ".,!?;:"
LETTERS = "a-zA-ZÀ-ÖØ-öø-ɏ"
# Marks and what follows up to the next mark, or line feed, or up to a stop after nothing but letters.
UNIT = re.compile(rf"{MARK}*(?:[{LETTERS}]++(?=[{STOPS}\n])|[^{MARK}\n]+)|{MARK}+|\n")


class PieceModel:
    """Pieces, scores and kinds of a model file, read through the library; the search is done here.

    ``merges``: whether the scores rank merges (BPE) or are log probabilities (unigram).
    """

    def __init__(self, path: str, merges: bool = True):
        from sentencepiece import SentencePieceProcessor
        library = SentencePieceProcessor(model_file=path)
        ids = range(library.get_piece_size())
        self.names = [library.id_to_piece(i) for i in ids]
        plain = [i for i in ids if not (library.is_control(i) or library.is_unknown(i)
                                        or library.is_byte(i) or library.is_unused(i))]
        self.merges = merges
        self.score = {self.names[i]: library.get_score(i) for i in plain}
        self.id = {self.names[i]: i for i in plain}
        self.byte_id = {int(self.names[i][1:-1], 16): i for i in ids if library.is_byte(i)}
        self.unknown = library.unk_id()
        self.longest = max(map(len, self.id), default=1)
        self.lowest = min(self.score.values(), default=0.0) - 10.0
        # All paths meet at a place that no piece runs over: before a mark that follows another
        # character, between a letter and a stop, around a line feed, if the pieces are like that.
        self.cuts = not any(
            MARK in name.lstrip(MARK) or "\n" in name
            or any(a.isalpha() and b in STOPS for a, b in zip(name, name[1:])) for name in self.id)
        byte_of = {i: bytes([b]) for b, i in self.byte_id.items()}
        self.text_of = [byte_of.get(i) if i in byte_of else
                        self.names[i].replace(MARK, " ").encode() if self.names[i] in self.id
                        else " ⁇ ".encode() if i == self.unknown else b"" for i in ids]
        self.ends: dict[str, str] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.sound: dict[str, bool] = {}
        self.known: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Short texts by plain merging: the best-scored pair first, of equals the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-self.score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:]))
                     if a + b in self.score]
            if not found:
                break
            i = min(found)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _whole(self, piece: str) -> bool:
        if piece not in self.sound:
            self.sound[piece] = len(piece) == 1 or self.merged(piece) == [piece]
        return self.sound[piece]

    def _goes(self, last: str, piece: str) -> bool:
        pair = (last, piece)
        if pair not in self.pairs:
            if len(self.pairs) > KNOWN_UNITS:
                self.pairs.clear()
            self.pairs[pair] = self.merged(last + piece) == [last, piece]
        return self.pairs[pair]

    def _step(self, window: str, at: int, low: int, lasts: list, scores: list) -> None:
        """Add the node behind character ``at`` of the window; nodes from ``low`` on are there."""
        end, best = at + 1, None
        for start in range(max(low, end - self.longest), end):
            piece = window[start:end]
            known = piece in self.score
            if (not known and start < at) or lasts[start] is None:
                continue
            if self.merges:
                if self._whole(piece) and (not lasts[start] or self._goes(lasts[start], piece)):
                    best = (0.0, piece)
                    break
            else:
                score = scores[start] + (self.score[piece] if known else self.lowest)
                if best is None or score > best[0]:
                    best = (score, piece)
        lasts.append(best[1] if best else None)
        scores.append(best[0] if best else 0.0)

    def _short(self, text: str) -> list[str]:
        """Pieces of a text that fits the window; nodes are shared by texts that begin alike."""
        ends, size = self.ends, len(text)
        if len(ends) > KNOWN_UNITS:
            ends.clear()
        ends[""] = ""
        done = size
        while text[:done] not in ends:
            done -= 1
        lasts = []
        for at in range(done):
            last = ends.get(text[:at])
            if last is None:  # forgotten, or never a node of its own
                done = at
                break
            lasts.append(last)
        lasts += [ends[text[:done]]]
        for at in range(done, size):
            self._step(text, at, 0, lasts, [])
            ends[text[:at + 1]] = lasts[-1]
        return self._path(text, size, lasts)

    def segment(self, text: str):
        """Yield settled pieces of a normalised text; keeps about two longest pieces of it."""
        window, lasts, scores = "", [""], [0.0]  # node i is before character i of the window
        for block in range(0, len(text), self.longest):
            window += text[block:block + self.longest]
            for at in range(len(lasts) - 1, len(window)):
                self._step(window, at, 0, lasts, scores)
            if len(window) < 2 * self.longest:
                continue
            # Where the paths from all nodes that a later piece can follow come together.
            low = len(window) - self.longest + 1
            ends = {i for i in range(low, len(window) + 1) if lasts[i] is not None}
            while len(ends) > 1 or max(ends) >= low:
                last = max(ends)
                ends.discard(last)
                ends.add(last - len(lasts[last]) if last else 0)
                if ends == {0}:
                    break
            boundary = ends.pop()
            if boundary:
                yield from self._path(window, boundary, lasts)
                window, scores = window[boundary:], [s - scores[boundary] for s in scores[boundary:]]
                lasts = lasts[boundary:]
                # The piece before the window still decides what may follow its first node.
        yield from self._path(window, len(window), lasts, True)

    @staticmethod
    def _path(window: str, end: int, lasts: list, first: bool = False) -> list[str]:
        pieces = []
        while end > 0:
            pieces.append(lasts[end])
            end -= len(lasts[end])
        return pieces[::-1]

    def _ids(self, pieces) -> bytes:
        out = []
        for piece in pieces:
            if piece in self.id:
                out.append(self.id[piece])
            elif self.byte_id:
                out += [self.byte_id[b] for b in piece.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return np.array(out, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers: a mark before the text and for each space."""
        if not text:
            return b""
        marked = MARK + text.replace(" ", MARK)
        if not self.cuts:
            return self._ids(self.segment(marked))
        out = []
        for unit in UNIT.findall(marked):
            ids = self.known.get(unit)
            if ids is None:
                short = self.merges and len(unit) <= 2 * self.longest
                ids = self._ids(self._short(unit) if short else self.segment(unit))
                if len(self.known) < KNOWN_UNITS:
                    self.known[unit] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids, without the space that stands for the first mark."""
        parts = list(map(self.text_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        text = b"".join(parts).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def model(path: str) -> PieceModel:
    return kept_by_worker(path, lambda: PieceModel(path))


def encoded(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_crc32, round_trip (decoding gives the text) and ids.

    Null text is empty, without ids. ``ids``: little-endian unsigned 32-bit, null unless wanted. A text that
    has the mark itself does not come back, as the mark reads as a space.
    """
    def rows(batches):
        pieces = model(path)
        for doc_ids, texts in chunks(batches, "doc_id", "text"):
            ids = [pieces.encode(t) for t in texts]
            yield {"doc_id": doc_ids, "n_tokens": [len(x) // 4 for x in ids],
                   "ids_crc32": [zlib.crc32(x) for x in ids],
                   "round_trip": [pieces.decode(x) == t for x, t in zip(ids, texts, strict=True)],
                   "ids": ids if with_ids else [None] * len(ids)}
    return through_arrow(docs.select("doc_id", whole_text()), rows,
                         "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, ids binary",
                         keeps=path)


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows with doc_id and ids; null ids give null."""
    def texts(batches):
        pieces = model(path)
        for batch in batches:
            yield {"doc_id": batch.column("doc_id"), "text": [
                None if x is None else pieces.decode(x) for x in batch.column("ids").to_pylist()]}
    return through_arrow(rows.select("doc_id", "ids"), texts, "doc_id long, text string", keeps=path)
