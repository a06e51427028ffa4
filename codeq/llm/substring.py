"""Repeated passages across documents, exact or fuzzy, by collinear chaining of shared word k-mers.

Every document gives the minimizers of its k-mers, short and long, numbered where it has one again.
Seeds are dealt out and sorted once, and links stream from that order: a seed that several documents have
links each of them to the first one and to the one before it, so a seed in n documents gives fewer than
2 n links. The links of two documents are chained with gap costs (a Fenwick tree over the place in the
first one finds the best predecessor), and chains are aligned word by word.
"""

from __future__ import annotations

import difflib
import functools
import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeq.llm.common import (
    chunks, free_name, kept_by_worker, larger_batches, numbered, settle, through_arrow, whole_text)

K = 5
WINDOW = 4  # any K + WINDOW - 1 words in common have a seed in common
LONG, LONG_WINDOW = 25, 26  # any 50 words in common have a long seed in common
GAP_COST = 0.05  # per word of either side between two links
MAX_GAP, MAX_SHIFT = 64, 16  # chains are cut at wider gaps, or shifts of the diagonal
MARGIN = 64  # words beside a chain that alignment may reach
AGAIN, MAX_STEP = 2, 12  # beyond a chain: words equal again, words passed before them
MIN_PIECE = 15
FILTER_BITS = 26
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
KNOWN_WORDS = 400_000
BYTES = 1 << 18  # of text that are hashed together
ENOUGH = 50  # equal words with one owner, within which no other owner is looked at


def _word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest
    known: dict[bytes, int] = kept_by_worker("word hashes", dict)
    if len(known) > KNOWN_WORDS:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxh64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def run_hashes(words: list[bytes], k: int) -> np.ndarray:
    """64-bit hashes of all runs of k words, of which there are some."""
    hashes = _word_hashes(words)
    count = len(words) - k + 1
    mixed = np.zeros(count, dtype=np.uint64)
    for i in range(k):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + count]
        mixed ^= mixed >> np.uint64(29)
    mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE, _WORD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)  # odd, so they have inverses


def _powers(base: np.uint64, count: int) -> np.ndarray:
    if count > 2 * BYTES:
        return _first_powers.__wrapped__(base, count)
    return _first_powers(base, 2 * BYTES)[:count]


@functools.lru_cache(maxsize=4)
def _first_powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _sums(values: np.ndarray, base: np.uint64, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """For each stretch the sum of its values, each times a power of the base by its place in the stretch."""
    so_far = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=so_far[1:])
    return (so_far[stops] - so_far[starts]) * _powers(_inverse(base), len(values) + 1)[starts]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, and the number of words before each text and after all.

    Whole arrays of bytes are hashed at once, in blocks that end between words.
    """
    data = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)]
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
    blank = _SPACE[data]
    edges = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    starts, stops = edges[::2], edges[1::2]
    hashes = np.zeros(len(starts), dtype=np.uint64)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(stops, starts[low] + BYTES, side="right")))
        base = starts[low]
        own = data[base:stops[high - 1]].astype(np.uint64) + np.uint64(1)
        hashes[low:high] = _sums(own, _BYTE, starts[low:high] - base, stops[low:high] - base)
        low = high
    return _mixed(hashes + (stops - starts).astype(np.uint64)), np.searchsorted(starts, begins)


def _slide(x: np.ndarray, size: int, least) -> np.ndarray:
    """``least`` (np.minimum or np.maximum) of every ``size`` neighbours."""
    have = 1
    while 2 * have <= size:
        x, have = least(x[:-have], x[have:]), 2 * have
    return least(x[:len(x) - (size - have)], x[size - have:]) if have < size else x


def _minimizers(hashes: np.ndarray, begins: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places among all words) of the k-mers of texts that are the least of some window of one text.

    A text of fewer k-mers than a window is one window.
    """
    count = len(hashes) - k + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.arange(count)
    runs = _mixed(_sums(hashes, _WORD, at, at + k))
    ends = np.repeat(begins[1:], np.diff(begins))[:count]  # where the text of a word ends
    whole = at + k <= ends
    picked = np.zeros(count, dtype=bool)
    if count >= window:
        least = _slide(np.where(whole, runs, np.uint64(2**64 - 1)), window, np.minimum)
        least = np.where(at[:len(least)] + window + k - 1 <= ends[:len(least)], least, np.uint64(0))
        edge = np.zeros(window - 1, dtype=np.uint64)
        picked = whole & (_slide(np.concatenate([edge, least, edge]), window, np.maximum) == runs)
    few = np.flatnonzero((np.diff(begins) >= k) & (np.diff(begins) < k + window - 1))
    for low, high in zip(begins[few], begins[few + 1] - k + 1, strict=True):
        picked[low + int(runs[low:high].argmin())] = True
    places = np.flatnonzero(picked)
    return runs[places], places


def minimizers(words: list[bytes], k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the k-mers of one text that are the least of some window; signed 64-bit hashes."""
    found, places = _minimizers(*word_hashes([b" ".join(words)]), k, window)
    return found.view(np.int64), places


def with_repeats(hashes: np.ndarray, places: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of documents, and for those that a document has again one more, told apart by how often before.

    By the plain seed every place meets the first place elsewhere, by the other one the second meets
    the second, and so on, which a text that goes round in circles needs to be chained.
    """
    order = np.lexsort((places, hashes, of))
    ordered, owner = hashes[order], of[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (ordered[1:] != ordered[:-1]) | (owner[1:] != owner[:-1])
    turn = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    again = turn > 0
    told = (ordered[again] ^ (turn[again] * np.int64(0x2545F4914F6CDD1D))) * np.int64(0x5851F42D4C957F2D)
    return np.append(hashes, told), np.append(places, places[order][again]), np.append(of, owner[again])


def seeds_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, place, number of the text): short seeds, and long ones, whose place p is told as -1 - p."""
    hashes, begins = word_hashes(texts)
    out = []
    for k, window in ((K, WINDOW), (LONG, LONG_WINDOW)):
        found, places = _minimizers(hashes, begins, k, window)
        of = np.searchsorted(begins, places, side="right") - 1
        seeds, places, of = with_repeats(found.view(np.int64), places - begins[of], of)
        out.append((seeds, places if k == K else -1 - places, of))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _seeds(docs: DataFrame, row: str) -> DataFrame:
    """(seed, key, pos) of all documents, as ``seeds_of`` gives them."""
    def rows(batches):
        for keys, texts in chunks(batches, "key", "text"):
            seeds, places, of = seeds_of([t.encode() for t in texts])
            yield {"seed": seeds, "pos": places, "key": np.array(keys, dtype=np.int64)[of]}
    return through_arrow(docs.select(F.col(row).alias("key"), whole_text()), rows, "seed long, key long, pos int")


class Linker:
    """Links from places that come by seed, key and place.

    Each place is linked to the first place of the first document that has the seed, and, of a short seed, to the
    first place of the last document before its own: where an early document has a seed by chance, two later ones that
    share a passage still meet. What is kept is one seed's two places.
    """

    def __init__(self):
        self.seed = self.first = self.before = self.own = None

    def links(self, seed: np.ndarray, key: np.ndarray, pos: np.ndarray) -> dict[str, np.ndarray]:
        held = [x for x in (self.first, self.before, self.own) if x is not None] if self.seed is not None else []
        kept = list(dict.fromkeys(held))
        seed = np.concatenate([np.full(len(kept), self.seed if kept else 0, dtype=np.int64), seed])
        key = np.concatenate([np.array([x[0] for x in kept], dtype=np.int64), key])
        pos = np.concatenate([np.array([x[1] for x in kept], dtype=np.int64), pos])
        at = np.arange(len(seed))
        new_seed = np.ones(len(seed), dtype=bool)
        new_seed[1:] = seed[1:] != seed[:-1]
        new_key = new_seed.copy()
        new_key[1:] |= key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(new_seed, at, 0))
        own = np.maximum.accumulate(np.where(new_key, at, 0))  # first place of the same document
        before = np.where(new_key & ~new_seed, own[np.maximum(at - 1, 0)], 0)
        before = np.maximum.accumulate(np.where(new_key, np.where(new_seed, at, before), 0))
        new = at >= len(kept)
        to_first = np.flatnonzero(new & (key != key[first]))
        # A long run is in no document by chance, so its first one is enough.
        to_before = np.flatnonzero(new & (pos >= 0) & (key != key[first]) & (key[before] != key[first]))
        if len(seed):
            self.seed = seed[-1]
            self.first, self.before, self.own = ((key[i], pos[i]) for i in (first[-1], before[-1], own[-1]))
        mine, other = np.concatenate([to_first, to_before]), np.concatenate([first[to_first], before[to_before]])
        x, y = pos[mine], pos[other]
        far = x < 0
        ends = [(key[mine], key[other], np.where(far, -1 - x, x), np.where(far, -1 - y, y))]
        ends.append((key[mine][far], key[other][far], -1 - x[far] + LONG - K, -1 - y[far] + LONG - K))
        return {n: np.concatenate([e[i] for e in ends]) for i, n in enumerate(("key", "owner", "pos", "owner_pos"))}


def _links(seeds: DataFrame) -> DataFrame:
    """(key, owner, pos, owner_pos) of all seeds, see ``Linker``; a long seed gives the links of both its ends."""
    def rows(batches):
        linker = Linker()
        for batch in batches:
            yield linker.links(*[batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64)
                                 for n in ("seed", "key", "pos")])
    dealt = seeds.repartition("seed").sortWithinPartitions("seed", "key", "pos")
    found = through_arrow(dealt, rows, "key long, owner long, pos int, owner_pos int")
    with larger_batches(seeds.sparkSession):
        return settle(found, "links")


class PrefixBest:
    """Fenwick tree: the greatest (value, index) put at any place before one."""

    def __init__(self, size: int):
        self.best = [(-1e18, -1)] * (size + 1)

    def put(self, place: int, value: float, index: int) -> None:
        place += 1
        best, new = self.best, (value, index)
        while place < len(best) and value > best[place][0]:  # what holds more, holds it further up too
            best[place] = new
            place += place & -place

    def before(self, place: int) -> tuple[float, int]:
        best, found = self.best, (-1e18, -1)
        while place:
            if best[place][0] > found[0]:
                found = best[place]
            place -= place & -place
        return found


def chain(pos: list[int], owner_pos: list[int], k: int = K, straight: bool = True) -> list[list[int]]:
    """Disjoint chains of links (given by rising ``pos``), best first; indexes, two or more each.

    A chain rises in both places. Its score is k per link less GAP_COST for each word passed on
    either side from one link to the next. Links of one diagonal are only looked at as such if ``straight``.
    """
    if straight and len(pos) > 1 and len(pos) == len(set(pos)) and len({y - x for x, y in zip(pos, owner_pos, strict=True)}) == 1:
        return _straight(pos, k)
    score, back = _rising(pos, owner_pos, k) or _scored(pos, owner_pos, k)
    used, chains = [False] * len(pos), []
    for end in sorted(range(len(pos)), key=score.__getitem__, reverse=True):  # of equal scores the first
        if used[end] or back[end] < 0:
            used[end] = True
            continue
        links, i = [], end
        while i >= 0 and not used[i]:
            used[i] = True
            links.append(i)
            i = back[i]
        if len(links) > 1:
            chains.append(links[::-1])
    return chains


def _far(dx: int, dy: int) -> bool:
    """Whether links that lie so far apart can't follow each other."""
    return dx > MAX_GAP or dy > MAX_GAP or abs(dx - dy) > MAX_SHIFT


def _rising(pos: list[int], owner_pos: list[int], k: int) -> tuple[list[float], list[int]] | None:
    """Scores and predecessors of links that rise in both places, where each may follow any before it.

    None for others, and where two are equally good, as the tree tells which is taken.
    """
    score, back = [float(k)], [-1]
    x, y = pos[0], owner_pos[0]
    best, at = k + GAP_COST * (x + y), 0
    for i in range(1, len(pos)):
        if pos[i] <= x or owner_pos[i] <= y:
            return None
        x, y = pos[i], owner_pos[i]
        value = best - GAP_COST * (x + y)
        if value > 0 and _far(x - pos[at], y - owner_pos[at]):
            value = 0
        score.append(k + max(0.0, value))
        back.append(at if value > 0 else -1)
        value = score[i] + GAP_COST * (x + y)
        if value == best:
            return None
        if value > best:
            best, at = value, i
    return score, back


def _scored(pos: list[int], owner_pos: list[int], k: int) -> tuple[list[float], list[int]]:
    """The score of each link and its best predecessor, -1 for none."""
    rank = {y: i for i, y in enumerate(sorted(set(owner_pos)))}
    tree, score, back = PrefixBest(len(rank)), [], []
    waiting: list[int] = []
    for i, (x, y) in enumerate(zip(pos, owner_pos, strict=True)):
        if waiting and pos[waiting[0]] < x:  # links of one place can't follow each other
            for j in waiting:
                tree.put(rank[owner_pos[j]], score[j] + GAP_COST * (pos[j] + owner_pos[j]), j)
            waiting = []
        value, j = tree.before(rank[y])
        value -= GAP_COST * (x + y)
        if j >= 0 and _far(x - pos[j], y - owner_pos[j]):
            value = 0
        score.append(k + max(0.0, value))
        back.append(j if value > 0 else -1)
        waiting.append(i)
    return score, back


def _straight(pos: list[int], k: int) -> list[list[int]]:
    """The chains of links that lie on one diagonal: each can only follow the one before it."""
    chains, score = [[0]], float(k)
    for i in range(1, len(pos)):
        step = pos[i] - pos[i - 1]
        left = score - 2 * GAP_COST * step
        if step <= MAX_GAP and left > 0:
            chains[-1].append(i)
            score = k + left
        else:
            chains.append([i])
            score = float(k)
    return [c for c in chains if len(c) > 1]


def equal_stretches(x: np.ndarray, y: np.ndarray, least: int = ENOUGH) -> list[tuple[int, int]]:
    """Stretches of a chain whose links leave no room for a word that differs, of so many words or more."""
    cut = np.flatnonzero((np.diff(x) != np.diff(y)) | (np.diff(x) > K)) + 1
    out = [(int(p[0]), int(p[-1]) + K) for p in np.split(x, cut)]
    return [p for p in out if p[1] - p[0] >= least]


def _chains(links: DataFrame) -> DataFrame:
    """(key, owner, pos, owner_pos) with the places of the links of a chain as arrays.

    A document's owners are taken in order. Where it has ENOUGH equal words with one, these are found, and links
    of others inside them are left out. What a task holds are the links of one document, fewer than two for
    each of its seeds, and of one batch. They come by document and are put in order here, whole batches at once.
    """
    names = ("key", "owner", "pos", "owner_pos")

    def of_documents(*links: np.ndarray) -> dict[str, list]:
        order = np.lexsort(links[::-1])
        key, owner, pos, owner_pos = (x[order] for x in links)
        pair = np.ones(len(key), dtype=bool)  # the first link of a document and an owner
        pair[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        new = pair.copy()  # short and long seeds may give the same link
        new[1:] |= (pos[1:] != pos[:-1]) | (owner_pos[1:] != owner_pos[:-1])
        met = np.diff(np.flatnonzero(np.append(pair[new], True)))
        several = np.flatnonzero(new)[np.repeat(met > 1, met)]
        again = ~np.append(new, True)[several + 1]
        key, owner, pos, owner_pos = (x[several] for x in (key, owner, pos, owner_pos))
        ends = np.cumsum(met[met > 1]).tolist()
        out: dict[str, list] = {n: [] for n in names}
        equal: list[tuple[int, int]] = []
        for low, high in zip([0, *ends], ends, strict=False):
            if low and key[low] != key[low - 1]:
                equal = []
            x, y, twice = pos[low:high], owner_pos[low:high], again[low:high]
            for first, stop in equal:
                inside = (x >= first) & (x + K <= stop)
                if inside.any():
                    x, y, twice = x[~inside], y[~inside], twice[~inside]
            if len(x) > 1:
                for found in chain(x.tolist(), y.tolist(), straight=not twice.any()):
                    for n, v in zip(names, (int(key[low]), int(owner[low]), x[found].tolist(), y[found].tolist()), strict=True):
                        out[n].append(v)
                    equal += equal_stretches(x[found], y[found])
        return out

    def rows(batches):
        held: list[list[np.ndarray]] = []  # of the document that the last batch ended with
        for batch in batches:
            new = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
            if not len(new[0]):
                continue
            cut = int(np.searchsorted(new[0], new[0][-1]))  # where the last document of the batch begins
            if held and (cut or held[0][0][0] != new[0][0]):
                yield of_documents(*[np.concatenate(x) for x in zip(*held, [x[:cut] for x in new], strict=True)])
                held = []
            elif cut:
                yield of_documents(*[x[:cut] for x in new])
            held.append([x[cut:] for x in new])
        if held:
            yield of_documents(*[np.concatenate(x) for x in zip(*held, strict=True)])
    dealt = links.repartition("key").sortWithinPartitions("key")
    found = through_arrow(dealt, rows, "key long, owner long, pos array<int>, owner_pos array<int>")
    with larger_batches(links.sparkSession):
        return settle(found, "chains")


def _among(keys: DataFrame, row: str) -> Column:
    """Whether a row may be in ``keys``: never false for one that is.

    A filter of 2^FILTER_BITS bits, whatever the size of the data. With very many keys more others
    pass; the joins behind it drop them.
    """
    def place(name: str) -> Column:
        return F.xxhash64(name).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))

    set_bits = keys.select(place("key").alias("at")).groupBy(
        F.shiftright("at", 6).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    words = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    words[set_bits["word"].to_numpy()] = set_bits["bits"].to_numpy()
    bits = keys.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def among(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series((bits.value[at >> 6] >> (at & 63)) & 1 == 1)
    return among(place(row))


class _Cutter:
    """Words of texts, of which the rows of one come together."""

    def __init__(self):
        self.key, self.words = None, []

    def around(self, key: int, text: bytes, first: int, stop: int) -> tuple[int, list[bytes]]:
        """Words first - MARGIN to stop + K + MARGIN of a text, and the number of the first of them."""
        if self.key != key:
            self.key, self.words = key, text.lower().split()
        low = max(0, first - MARGIN)
        return low, self.words[low:stop + K + MARGIN]


def _moves(a: list, b: list) -> list[tuple[int, int, int]]:
    """How two stretches that need not be of one length go together: (words of a, words of b, equal)."""
    straight: list[tuple[int, int, int]] = []
    if len(a) == len(b):
        straight = [(1, 1, int(x == y)) for x, y in zip(a, b, strict=True)]
        if 5 * sum(m[2] for m in straight) >= 4 * len(straight) or len(straight) < 4:
            return straight
    out: list[tuple[int, int, int]] = []
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        both = min(i2 - i1, j2 - j1)
        out += [(1, 1, int(tag == "equal"))] * both
        out += [(1, 0, 0)] * (i2 - i1 - both) + [(0, 1, 0)] * (j2 - j1 - both)
    return straight if straight and sum(m[2] for m in straight) >= sum(m[2] for m in out) else out


def _onward(a: list, b: list) -> list[tuple[int, int, int]]:
    """How the beginnings of two texts go together, as far as they do.

    Past words that differ it goes on where the fewest of either side are passed and AGAIN words are
    equal, or one behind a single other word; ends where there is no such place near.
    """
    i = j = 0
    out: list[tuple[int, int, int]] = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((1, 1, 1))
            i, j = i + 1, j + 1
            continue
        step = _step(a[i:i + MAX_STEP + AGAIN], b[j:j + MAX_STEP + AGAIN])
        if step is None:
            break
        x, y = step
        out += [(1, 1, int(a[i + d] == b[j + d])) for d in range(min(x, y))]
        out += [(1, 0, 0)] * (x - y) + [(0, 1, 0)] * (y - x)
        i, j = i + x, j + y
    return out


def _step(a: list, b: list) -> tuple[int, int] | None:
    """The fewest words to pass on either side, MAX_STEP at most, before AGAIN words that are equal."""
    places: dict[bytes, list[int]] = {}
    for y, word in enumerate(b[:MAX_STEP + 1]):
        places.setdefault(word, []).append(y)
    best = None
    for x, word in enumerate(a[:MAX_STEP + 1]):
        if best is not None and x > best[0]:
            break
        for y in places.get(word, ()):
            need = 1 if x == y == 1 else AGAIN
            if x + y and len(a) >= x + need and a[x:x + need] == b[y:y + need]:
                rank = (max(x, y), abs(x - y), x, y)
                best = rank if best is None or rank < best else best
    return None if best is None else best[2:]


def _alike_spans(moves: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The longest spans whose equal words are 0.8 or more of the longer side, then those beside them.

    No beginning or end of a span lowers its likeness below a half: words that are not alike are
    only passed if as many equal ones lie on either side.
    """
    if len(moves) >= least and moves.min() == 1:
        return [(0, len(moves))]
    sums = np.vstack([[0, 0, 0], np.cumsum(moves, axis=0)])
    good_a, good_b = 5 * sums[:, 2] - 4 * sums[:, 0], 5 * sums[:, 2] - 4 * sums[:, 1]
    height = 2 * sums[:, 2] - np.arange(len(sums))
    found, waiting = [], [(0, len(moves))]
    while waiting:
        low, high = waiting.pop()
        for start, stop in _halves(height, low, high):
            if stop - start < least:
                continue
            for size in range(stop - start, least - 1, -1):
                fits = ((good_a[start + size:stop + 1] >= good_a[start:stop + 1 - size])
                        & (good_b[start + size:stop + 1] >= good_b[start:stop + 1 - size]))
                if fits.any():
                    first = start + int(fits.argmax())
                    last = first + size
                    if first > start or last < stop:
                        waiting += [(start, first), (last, stop)]
                    equal = np.flatnonzero(moves[first:last, 2])
                    found.append((first + int(equal[0]), first + int(equal[-1]) + 1))
                    break
    return found


def _halves(height: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
    """Maximal stretches of which every beginning and end is more than half equal."""
    own = height[low:high + 1]
    if len(own) < 2:
        return []
    if own[1:].min() > own[0] and own[:-1].max() < own[-1]:
        return [(low, high)]
    out: list[tuple[int, int]] = []  # after Ruzzo and Tompa
    values = own.tolist()
    for at in range(len(values) - 1):
        if values[at + 1] < values[at]:
            continue
        new = (at, at + 1)
        while True:
            k = len(out) - 1
            while k >= 0 and values[out[k][0]] >= values[new[0]]:
                k -= 1
            if k < 0 or values[out[k][1]] >= values[new[1]]:
                out.append(new)
                break
            new = (out[k][0], new[1])
            del out[k:]
    return [(low + x, low + y) for x, y in out]


def _along(a: list, b: list, pos: list[int], owner_pos: list[int]) -> tuple[list[tuple[int, int, int]], int, int]:
    """How the words from the first link of a chain to its last go together, and where that ends."""
    i, j = pos[0], owner_pos[0]
    columns: list[tuple[int, int, int]] = []
    for x, y in zip(pos, owner_pos, strict=True):
        if x - i != y - j and (x < i or y < j):
            continue  # overlaps the link before it on another diagonal
        if x > i or y > j:
            columns += _moves(a[i:x], b[j:y])
        i, j = max(i, x), max(j, y)
        step = x + K - i
        if y + K - j == step and step > 0:
            columns += [(1, 1, int(a[i + d] == b[j + d])) for d in range(step)]
            i, j = i + step, j + step
    return columns, i, j


def align(a: list, b: list, pos: list[int], owner_pos: list[int],
          least: int = MIN_PIECE) -> list[tuple[int, int, int, int, int]]:
    """Alike pieces (start, stop, owner start, owner stop, equal words) along a chain.

    Equal words are at least 0.8 of the longer side of a piece, over the whole of it.
    """
    before = _onward(a[:pos[0]][::-1], b[:owner_pos[0]][::-1])[::-1]
    i, j = start = pos[0], owner_pos[0]
    stop, owner_stop = pos[-1] + K, owner_pos[-1] + K
    if stop - i == owner_stop - j and a[i:stop] == b[j:owner_stop]:
        columns, i, j = np.ones((stop - i, 3), dtype=np.int64), stop, owner_stop
    else:
        columns, i, j = _along(a, b, pos, owner_pos)
    # (words of a, words of b, equal words) passed by each move
    moves = np.concatenate([np.array(x, dtype=np.int64).reshape(-1, 3) for x in (before, columns, _onward(a[i:], b[j:]))])
    start = (start[0] - sum(m[0] for m in before), start[1] - sum(m[1] for m in before))
    ends = np.vstack([[0, 0], np.cumsum(moves[:, :2], axis=0)]) + start
    pieces = []
    for first, stop in _alike_spans(moves, least):
        (x1, y1), (x2, y2) = ends[first].tolist(), ends[stop].tolist()
        if x2 - x1 >= least:
            pieces.append((x1, x2, y1, y2, int(moves[first:stop, 2].sum())))
    return pieces


def _pieces(docs: DataFrame, row: str, chains: DataFrame) -> DataFrame:
    """Align chains: the words around each chain are cut from one text, then held to the other."""
    keys = chains.select("key").union(chains.select("owner"))
    texts = docs.filter(_among(keys, row)).select(F.col(row).alias("key"), whole_text().cast("binary").alias("text"))
    names = ("key", "owner", "pos", "owner_pos", "low", "words")

    def cut(batches):
        cutter = _Cutter()
        for lists in chunks(batches, "key", "owner", "pos", "owner_pos", "text"):
            out = {n: [] for n in names}
            for key, owner, pos, owner_pos, text in zip(*lists, strict=True):
                low, words = cutter.around(key, text, pos[0], pos[-1])
                for n, v in zip(names, (key, owner, pos, owner_pos, low, b" ".join(words)), strict=True):
                    out[n].append(v)
            yield out

    def hold(batches):
        cutter = _Cutter()
        for lists in chunks(batches, *names, "text"):
            out = {n: [] for n in ("key", "start", "stop", "owner", "owner_start", "owner_stop", "equal")}
            for key, owner, pos, owner_pos, low, words, text in zip(*lists, strict=True):
                base, others = cutter.around(owner, text, owner_pos[0], owner_pos[-1])
                found = align(words.split(b" "), others, [x - low for x in pos],
                              [y - base for y in owner_pos])
                for x1, x2, y1, y2, equal in found:
                    for n, v in zip(out, (key, x1 + low, x2 + low, owner, y1 + base, y2 + base, equal),
                                    strict=True):
                        out[n].append(v)
            yield out
    mine = through_arrow(chains.join(texts, "key"), cut,
                         "key long, owner long, pos array<int>, owner_pos array<int>, low int, words binary")
    other = texts.withColumnRenamed("key", "owner")
    return settle(through_arrow(
        mine.join(other, "owner").select(*names, "text"), hold,
        "key long, start int, stop int, owner long, owner_start int, owner_stop int, equal int"), "pieces")


def _runs(pieces: DataFrame, min_words: int) -> DataFrame:
    """Pieces of one document that meet or overlap, as one run; runs of ``min_words`` or more."""
    order = Window.partitionBy("key").orderBy("start", "stop", "owner", "owner_start")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parted = pieces.withColumn("new", (F.col("start") > F.coalesce(reach, F.lit(-1))).cast("int")).withColumn(
        "run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    longest = F.struct((F.col("stop") - F.col("start")).alias("n"), -F.col("owner"), -F.col("owner_start"),
                       "owner", "owner_start", "owner_stop", "equal")
    return parted.groupBy("key", "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.max(longest).alias("best"),
    ).filter(F.col("stop") - F.col("start") >= min_words).select(
        "key", "start", "stop", "best.owner", "best.owner_start", "best.owner_stop",
        (F.col("best.equal") / F.greatest("best.n", F.col("best.owner_stop") - F.col("best.owner_start")))
        .alias("similarity"))


def _numbered_passages(docs: DataFrame, row: str, min_words: int) -> DataFrame:
    return _runs(_pieces(docs, row, _chains(_links(_seeds(docs, row)))), min_words)


def passages(docs: DataFrame, min_words: int = ENOUGH) -> DataFrame:
    """Passages of ``min_words`` or more that an earlier document has too, 0.8 alike or more.

    Columns: doc_id, start_word, end_word (words from start to before end), other_id, other_start,
    other_end, similarity. Words are split at ASCII white space, A-Z lower-cased. "Earlier" is by
    the place of the row in the table, so null and repeated doc_ids do no harm; repeated rows are
    copies of each other. Where neighbouring parts come from several documents, the passage is their
    union, and the other columns are those of its longest part. Null text has no words.
    """
    row = free_name(docs, "_row")
    docs = numbered(docs.select("doc_id", "text"), row)
    found = settle(_numbered_passages(docs, row, min_words), "passages")
    names = docs.select(F.col(row).alias("key"), F.col("doc_id"))
    return (found.join(names, "key").join(
        names.select(F.col("key").alias("owner"), F.col("doc_id").alias("other_id")), "owner").select(
        "doc_id", F.col("start").alias("start_word"), F.col("stop").alias("end_word"), "other_id",
        F.col("owner_start").alias("other_start"), F.col("owner_stop").alias("other_end"), "similarity"))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of these spans and the white space before them."""
    data = text.encode()
    ends = [m.end() for m in WORD.finditer(data)]
    kept, at = [], 0
    for start, stop in sorted(spans):
        kept.append(data[at:ends[start - 1] if start else 0])
        at = ends[stop - 1]
    return b"".join([*kept, data[at:]]).decode()


def drop_passages(docs: DataFrame, min_words: int = ENOUGH) -> DataFrame:
    """The documents without passages that an earlier one has, in their own columns.

    ``n_chars``, where there is such a column, is counted anew; a document with no word left goes,
    one that had none before stays.
    """
    row, maybe, changed = (free_name(docs, n) for n in ("_row", "_maybe", "_left"))
    rows = numbered(docs, row)
    found = _numbered_passages(rows, row, min_words).groupBy(F.col("key").alias(row)).agg(
        F.collect_list(F.struct("start", "stop")).alias("spans"))

    def cut(batches):
        for keys, spans, texts in chunks(batches, "key", "spans", "text"):
            yield {"key": keys, "left": [
                without(t, [(s["start"], s["stop"]) for s in x]) for t, x in zip(texts, spans, strict=True)]}
    found = settle(found, "spans")
    rows = rows.withColumn(maybe, _among(found.select(F.col(row).alias("key")), row))
    texts = rows.filter(maybe).select(F.col(row).alias("key"), whole_text())
    left = through_arrow(found.withColumnRenamed(row, "key").join(texts, "key").select(
        "key", "spans", "text"), cut, "key long, left string").toDF(row, changed)
    joined = rows.filter(maybe).join(left, row, "left").filter(
        F.col(changed).isNull() | F.col(changed).rlike(r"[^\x20\x09-\x0D]"))
    text = F.coalesce(F.col(changed), F.col("text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(changed).isNull(), F.col("n_chars")).otherwise(
            F.char_length(text)).cast(docs.schema["n_chars"].dataType)
    same = rows.filter(~F.col(maybe)).select(*[F.col(f"`{c}`") for c in docs.columns])
    return same.union(joined.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`")
                                      for c in docs.columns]))
