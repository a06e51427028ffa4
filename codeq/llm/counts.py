"""Token counts by rank-synchronous merging of ragged arrays.

All pre-tokens of a batch lie behind each other in one array of symbols. In each step every one of
them applies its own lowest-ranked pair, wherever it occurs; those without a pair are done, and what
is counted are the symbols left.
"""

from __future__ import annotations

import json

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeq.llm.common import chunks, kept_by_worker, through_arrow, whole_text
from codeq.llm.subwords import byte_letters

# White space and the pre-token pattern of the byte-level vocabulary.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
           rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
NONE = np.iinfo(np.int64).max
KNOWN_WORDS = 800_000


class RankCounter:
    """Counts of a byte-level BPE vocabulary file, kept by word as long as there is room."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        ids = data["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        left, right, made = (np.array([ids[x] for x in xs], dtype=np.int64) for xs in
                             ([a for a, _ in merges], [b for _, b in merges], [a + b for a, b in merges]))
        rank_of = np.full(max(ids.values()) + 1, -1)
        rank_of[made] = np.arange(len(made))
        if len(np.unique(made)) < len(made) or (np.maximum(rank_of[left], rank_of[right])
                                                >= np.arange(len(made))).any():
            raise ValueError("a pair may rank before what it is made of; merge one by one instead")
        keys = (left << 32) | right
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order, made[order]
        self.bytes = np.array([ids[c] for c in byte_letters()], dtype=np.int64)
        special = sorted((t["content"] for t in data["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern, self.known = regex.compile(PATTERN), {}

    def surviving(self, pretokens: list[bytes]) -> np.ndarray:
        """How many symbols each of these pre-tokens (not empty) ends with."""
        sizes = np.array([len(p) for p in pretokens], dtype=np.int64)
        symbols = self.bytes[np.frombuffer(b"".join(pretokens), dtype=np.uint8)]
        out, names = np.ones(len(sizes), dtype=np.int64), np.arange(len(sizes))
        while len(sizes):
            starts = np.cumsum(sizes) - sizes
            pairs = np.append((symbols[:-1] << 32) | symbols[1:], -1)
            pairs[starts + sizes - 1] = -1  # the last symbol has no partner
            at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
            rank = np.where(self.keys[at] == pairs, self.ranks[at], NONE)
            lowest = np.minimum.reduceat(rank, starts)
            hit = np.flatnonzero((rank == np.repeat(lowest, sizes)) & (rank != NONE))
            # Hits in a row overlap (the pair's two symbols are equal): every other one, from the left.
            run = np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) != 1, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            symbols[hit] = self.made[at[hit]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[hit + 1] = False
            sizes = np.add.reduceat(keep, starts, dtype=np.int64)
            out[names] = sizes
            going = lowest != NONE
            symbols = symbols[keep][np.repeat(going, sizes)]
            names, sizes = names[going], sizes[going]
        return out

    def _count(self, units: list[str]) -> list[int]:
        """Tokens of texts that are pre-tokenised apart."""
        owner, pretokens, totals = [], [], np.zeros(len(units), dtype=np.int64)
        for i, unit in enumerate(units):
            parts = [unit]
            if self.special and self.special.search(unit):
                totals[i] = len(self.special.findall(unit))
                parts = self.special.split(unit)
            for part in parts:
                found = self.pattern.findall(part)
                pretokens += [p.encode() for p in found]
                owner += [i] * len(found)
        if pretokens:
            np.add.at(totals, owner, self.surviving(pretokens))
        return totals.tolist()

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts.

        A text is cut before each space that follows a character that is no white space, where a
        pre-token always begins; one with other spaces is taken in one piece.
        """
        split = []
        for text in texts:
            first, *words = text.split(" ")
            units = [first, *[f" {w}" for w in words]]
            plain = first and not first[-1].isspace() and "" not in words and not any(
                w[-1].isspace() for w in words[:-1])
            split.append(units if plain or not words else [text])
        new = list(set().union(*split).difference(self.known))
        fresh = dict(zip(new, self._count(new), strict=True))
        known = self.known
        if len(known) + len(fresh) <= KNOWN_WORDS:
            known.update(fresh)
        else:
            known = {u: fresh[u] if u in fresh else known[u] for units in split for u in units}
        return [sum(map(known.__getitem__, units)) for units in split]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit; null text is empty, rows stay as they are."""
    def rows(batches):
        counter = kept_by_worker(vocabulary, lambda: RankCounter(vocabulary))
        for doc_ids, n_bytes, texts in chunks(batches, "doc_id", "n_bytes", "text"):
            n_tokens = counter.counts(texts)
            yield {"doc_id": doc_ids, "n_bytes": n_bytes, "n_tokens": n_tokens,
                   "over_limit": [n > limit for n in n_tokens]}
    whole = docs.select("doc_id", whole_text()).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return through_arrow(whole, rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean",
                         keeps=vocabulary)
