"""Languages of documents as mixtures.

Words are the observations: a language gives each a likelihood from the byte trigrams around its
letters. Expectation-maximisation finds the share of each language in a document; then sets of
languages, the largest shares first, are compared by their likelihood less a penalty for each one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeq.llm.common import chunks, release, small_batches, through_arrow

BUCKETS = 1 << 16
STEPS = 12
LEAST_SHARE = 0.02  # languages with less are not considered
PENALTY = 4.0  # per language and unit of log(words) / 2; word likelihoods are sharper than they should be
FLOOR = 0.05 / BUCKETS  # a trigram less likely than this is no language's
UNKNOWN = "und"
KNOWN_WORDS = 150_000
CHARS = 1 << 20
MOST_LANGUAGES = 256  # a model of so many is gathered by the driver and sent to workers; more are refused
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def _words(text: str) -> list[bytes]:
    """Runs of letters, lower-cased; any byte of a character beyond ASCII counts as one."""
    return text.lower().encode().translate(_LETTERS).split()


def _trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of the trigram around each letter, first letter of each word)."""
    data = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.uint32)
    mixed = data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA77) + data[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    buckets = (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    letters = data[1:-1] != 32
    first = np.cumsum(letters) - letters  # letters before each place
    return buckets[letters], first[starts]


class Mixture:
    """Trigram log likelihoods per language (sorted by name) and what is known of words."""

    def __init__(self, languages: list[str], logs: np.ndarray):
        self.languages, self.logs = languages, logs.astype(np.float32)
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((1024, len(languages)), dtype=np.float32)
        seen = self.logs > self.logs.min(axis=1, keepdims=True)  # trigrams that were not counted are least likely
        self.own = (seen & (self.logs > np.log(FLOOR))).any(axis=0)
        self.sure = np.zeros(1024, dtype=bool)

    def _of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of each word (row) in each language; whether half its trigrams are of some language."""
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        new = list(set(words).difference(self.known))
        if new:
            buckets, starts = _trigrams(new)
            found = np.add.reduceat(self.logs[:, buckets], starts, axis=1).T
            at = len(self.known)
            while len(self.table) < at + len(new):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
                self.sure = np.append(self.sure, np.zeros_like(self.sure))
            self.table[at:at + len(new)] = found
            self.sure[at:at + len(new)] = 2 * np.add.reduceat(
                self.own[buckets].astype(np.int64), starts) >= np.diff(starts, append=len(buckets))
            self.known.update(zip(new, range(at, at + len(new)), strict=True))
        places = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        return self.table[places], self.sure[places]

    @staticmethod
    def _maximise(scaled, top, starts, sizes, shares) -> tuple[np.ndarray, np.ndarray]:
        """EM from these shares (zero stays zero): shares and log likelihood per document."""
        for _ in range(STEPS):
            part = scaled * np.repeat(shares, sizes, axis=0)
            part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-30)
            shares = np.add.reduceat(part, starts, axis=0) / sizes[:, None]
        mixed = (scaled * np.repeat(shares, sizes, axis=0)).sum(axis=1, dtype=np.float64)
        return shares, np.add.reduceat(np.log(np.maximum(mixed, 1e-300)) + top, starts)

    def predict(self, texts: list[str]) -> list[tuple[str, float, list[str], float]]:
        """(language, its share, languages of the document, share of words that these hold) of whole texts.

        A few megabytes in all. A word most of whose trigrams are no language's is held by none.
        """
        out: list[tuple[str, float, list[str], float]] = [(UNKNOWN, 0.0, [], 0.0)] * len(texts)
        words, sizes, asked = [], [], []
        for i, text in enumerate(texts):
            if self.languages and any(map(str.isalpha, text)):
                own = _words(text)
                words += own
                sizes.append(len(own))
                asked.append(i)
        if not asked:
            return out
        (logs, sure), sizes = self._of(words), np.array(sizes)
        starts = np.cumsum(sizes) - sizes
        top = logs.max(axis=1)
        scaled = np.exp(logs - top[:, None])
        top = top.astype(np.float64)
        count = len(self.languages)
        even = np.full((len(sizes), count), 1 / count, dtype=np.float32)
        full, _ = self._maximise(scaled, top, starts, sizes, even)
        order = np.argsort(-full, axis=1, kind="stable")
        price = PENALTY * np.log(np.maximum(sizes, 2)) / 2
        single = np.add.reduceat(logs, starts, axis=0, dtype=np.float64)
        best_value = single.max(axis=1) - price
        best = np.zeros_like(full)
        best[np.arange(len(sizes)), single.argmax(axis=1)] = 1
        likely = (full >= LEAST_SHARE).sum(axis=1)
        for size in range(2, count + 1):
            docs = np.flatnonzero(likely >= size)
            if not len(docs):
                break
            chosen = np.zeros((len(docs), count), dtype=np.float32)
            np.put_along_axis(chosen, order[docs, :size], 1 / size, axis=1)
            rows = np.repeat(np.isin(np.arange(len(sizes)), docs), sizes)
            own = sizes[docs]
            shares, value = self._maximise(scaled[rows], top[rows], np.cumsum(own) - own, own, chosen)
            value -= size * price[docs]
            better = value > best_value[docs]
            best[docs[better]], best_value[docs[better]] = shares[better], value[better]
        part = scaled * np.repeat(full, sizes, axis=0)
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-30)
        part *= np.repeat(best > 0, sizes, axis=0)
        held = np.add.reduceat(part.sum(axis=1) * sure, starts) / sizes
        for i, shares, mixed, own in zip(asked, best, full, held.tolist(), strict=True):
            first = int(shares.argmax())
            out[i] = (self.languages[first], min(1.0, max(0.0, float(mixed[first]))),
                      [n for n, s in zip(self.languages, shares, strict=True) if s > 0], own)
        return out


def held_out() -> Column:
    """Whether crc32(doc_id as text) mod 3 is 1; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame) -> Mixture:
    """Count the trigrams of every document that is not held out and has a language and a text.

    All of them count. The model has BUCKETS numbers per language, whatever the size of the data; more than
    MOST_LANGUAGES distinct values of lang are refused with an error, not cut.
    """
    told = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("lang").distinct()
    if told.limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values; it should name languages")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for langs, texts in chunks(batches, "lang", "text"):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(langs, texts, strict=True):
                by_lang.setdefault(lang, []).extend(_words(text))
                if len(by_lang[lang]) > CHARS // 16:
                    _add(sums, lang, by_lang.pop(lang))
            for lang, words in by_lang.items():
                _add(sums, lang, words)
        for lang, values in sums.items():
            found = np.flatnonzero(values)
            yield {"lang": [lang] * len(found), "bucket": found, "n": values[found]}
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()
                        & F.col("doc_id").isNotNull() & ~held_out()).select("lang", "text")
    counts = through_arrow(known, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n")).toArrow()
    langs = counts["lang"].to_pylist()
    languages = sorted(set(langs))
    table = np.zeros((len(languages), BUCKETS))
    place = {lang: i for i, lang in enumerate(languages)}
    table[[place[x] for x in langs], counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    seen = max(1, int((table.sum(axis=0) > 0).sum()))
    logs = np.log((table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * seen)) if languages else table
    return Mixture(languages, logs)


def _add(sums: dict[str, np.ndarray], lang: str, words: list[bytes]) -> None:
    if words:
        buckets, _ = _trigrams(words)
        sums[lang] = sums.get(lang, 0) + np.bincount(buckets, minlength=BUCKETS)


def predictor(spark: SparkSession, mixture: Mixture):
    """Column function of a text: struct of lang_pred, score, languages and held."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast((mixture.languages, mixture.logs))
    ready: list[Mixture] = []

    @F.pandas_udf("lang_pred string, score double, languages array<string>, held double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        if not ready:
            release()
            ready.append(Mixture(*shared.value))
        found, held, size = [], [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size > CHARS:
                found += ready[0].predict(held)
                held, size = [], 0
        found += ready[0].predict(held)
        return pd.DataFrame(found, columns=["lang_pred", "score", "languages", "held"])
    return predict


def languages(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, languages.

    Only text and language of documents that are not held out are learned from. Null text, and text
    without a letter, is ``und`` with score 0, and so is all text if there is nothing to learn from.
    """
    predict = predictor(docs.sparkSession, learn(docs))
    return docs.select("doc_id", held_out().alias("held_out"), predict("text").alias("found")).select(
        "doc_id", "held_out", "found.lang_pred", "found.score", "found.languages")


def in_known_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose languages together hold at least this share of their words, all columns."""
    predict = predictor(docs.sparkSession, learn(docs))
    return docs.filter(predict("text")["held"] >= least)
