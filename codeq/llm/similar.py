"""Near copies by the Jaccard similarity of word shingles: SimHash and MinHash bands propose pairs, the texts decide.

Fingerprints of the same shingles within ``RADIUS`` bits are linked by the general pigeonhole principle
(``simhash``). Copies at 0.8 often differ in more bits than any radius can reach at scale, so bands of minima
propose the rest: a pair of similarity s shares one of BANDS values of ROWS minima with probability
1 - (1 - s^ROWS)^BANDS, 0.99993 at 0.8, more above. Every proposed pair is held to its texts, once.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeq.llm.common import chunks, drop, free_name, numbered, recorded, settle, through_arrow, whole_text
from codeq.llm.components import below_roots
from codeq.llm.simhash import fingerprint, hamming_links
from codeq.llm.substring import _among, run_hashes

RADIUS = 2  # bits that fingerprints linked by SimHash differ in at most
ROWS, BANDS = 5, 24
SHARE = 16  # a bucket is compared pair by pair up to so many pairs per entry; others meet by hubs and rare shingles
STEP = 1.05  # a class of lengths
SLOTS = 1 << 18  # counts that tell rare shingles
BLOCK = 1 << 12
_RANDOM = np.random.default_rng(42)
_FACTORS = _RANDOM.integers(1 << 63, size=(ROWS * BANDS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(1 << 63, size=(ROWS * BANDS, 1), dtype=np.uint64)


def shingles(text: str, width: int = 5) -> np.ndarray:
    """Rising 64-bit hashes of the shingles; a text of fewer words than ``width`` is one shingle.

    Words are split at ASCII white space after lower-casing A-Z; without words there is none.
    """
    words = text.encode().lower().split()
    return np.unique(run_hashes(words, min(width, len(words)))) if words else np.zeros(0, np.uint64)


def bands(hashes: np.ndarray) -> np.ndarray:
    """One signed 64-bit value per band; none for no shingles."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.min([(hashes[at:at + BLOCK] * _FACTORS + _TERMS).min(axis=1)
                    for at in range(0, len(hashes), BLOCK)], axis=0).reshape(BANDS, ROWS)
    value = np.zeros(BANDS, dtype=np.uint64)
    for row in least.T:
        value = (value ^ row) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    return value.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _signed(rows: DataFrame, row: str, width: int) -> DataFrame:
    """(key, same, n, fp, bands): hash and number of the shingles, the SimHash fingerprint, the values of the bands."""
    def sign(batches):
        from xxhash import xxh64_intdigest
        for keys, texts in chunks(batches, "key", "text"):
            found = [shingles(t, width) for t in texts]
            same = np.array([xxh64_intdigest(f.tobytes()) for f in found], dtype=np.uint64).view(np.int64)
            prints = np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64)
            yield {"key": keys, "same": same, "n": [len(f) for f in found], "fp": prints,
                   "bands": [bands(f) for f in found]}
    return settle(through_arrow(rows.select(F.col(row).alias("key"), whole_text()), sign,
                                "key long, same long, n int, fp long, bands array<long>", keeps="word hashes"), "signed")


def _alike(pairs: DataFrame, rows: DataFrame, row: str, least: float, width: int,
           seen: list[DataFrame]) -> DataFrame:
    """The pairs (a, b) whose texts are alike, each once; those in ``seen`` were held to their texts before."""
    pairs = pairs.select("a", "b").distinct()
    if seen:
        pairs = pairs.join(reduce(DataFrame.union, seen), ["a", "b"], "left_anti")
    pairs = settle(pairs, "proposed")
    seen.append(pairs)
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b"))
    texts = rows.filter(_among(keys, row)).select(F.col(row).alias("key"), whole_text())

    def hold(batches):
        for a, b, first, text in chunks(batches, "a", "b", "first", "text"):
            known: dict[int, np.ndarray] = {}  # a hub is in many pairs
            for key, t in [*zip(a, first, strict=True), *zip(b, text, strict=True)]:
                if key not in known:
                    known[key] = shingles(t, width)
            good = [(x, y) for x, y in zip(a, b, strict=True) if jaccard(known[x], known[y]) >= least]
            yield {"a": [x for x, _ in good], "b": [y for _, y in good]}
    met = pairs.join(texts.withColumnRenamed("text", "first"), F.col("a") == F.col("key")).drop("key").join(
        texts, F.col("b") == F.col("key")).select("a", "b", "first", "text")
    return settle(through_arrow(met, hold, "a long, b long", keeps="word hashes"), "alike")


def _needed(least: float, n, m):
    """How many shingles two texts of n and m have in common at least, if they are alike; a little less, for rounding."""
    return least / (1 + least) * (n + m) - 1e-6


def prefixes(hashes: np.ndarray, counts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where a text meets all that are alike: (place, rank of the shingle, whether it is the longer one there).

    Shingles are ranked, those with rare slots first. The first one two alike texts have in common cannot
    stand so late in either that too few are left behind it. The shorter text has a place per shingle up to
    there; the longer one has them per class of lengths that the shorter may have.
    """
    n = len(hashes)
    ranked = hashes[np.lexsort((hashes, counts[hashes & np.uint64(SLOTS - 1)]))]

    def places(up_to: float, size: int) -> np.ndarray:
        held = ranked[:max(0, int(np.floor(n - up_to)) + 1)]
        return (held ^ np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
    sizes = range(_size(max(1, int(np.ceil(least * n - 1e-6)))), _size(n) + 1)
    found = [places(_needed(least, n, n), _size(n))]
    found += [places(_needed(least, n, max(least * n - 1e-6, int(STEP ** size))), size) for size in sizes]
    return (np.concatenate(found).view(np.int64), np.concatenate([np.arange(len(f)) for f in found]),
            np.arange(sum(map(len, found))) >= len(found[0]))


def _size(n: int) -> int:
    """The class of a length; one class spans a twentieth."""
    return int(np.log(n) / np.log(STEP) + 1e-9)


def _ranked(members: DataFrame, rows: DataFrame, row: str, least: float, width: int) -> DataFrame:
    """(key, n, place, at, longer) of these documents: where all of them that are alike meet.

    What shingles are rare is told by counts of SLOTS slots, over these documents, whatever their number.
    Places where no shorter one meets a longer one are left out.
    """
    keys = settle(members.select("key").distinct(), "keys")
    texts = rows.select(F.col(row).alias("key"), whole_text()).filter(_among(keys, "key")).join(keys, "key", "left_semi")

    def count(batches):
        held = np.zeros(SLOTS, np.int64)
        for _, found in chunks(batches, "key", "text"):
            for text in found:
                held += np.bincount((shingles(text, width) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        slots = np.flatnonzero(held)
        yield {"slot": slots, "held": held[slots]}
    total = through_arrow(texts, count, "slot int, held long", keeps="word hashes").groupBy("slot").agg(
        F.sum("held").alias("held")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[total["slot"].to_numpy()] = total["held"].to_numpy()
    told = rows.sparkSession.sparkContext.broadcast(counts)  # 2 MB

    def rank(batches):
        for keys, found in chunks(batches, "key", "text", chars=1 << 18):
            hashes = [shingles(text, width) for text in found]
            met = [prefixes(h, told.value, least) for h in hashes]
            if not met:
                continue
            each = [len(m[0]) for m in met]
            yield {"key": np.repeat(np.array(keys, np.int64), each), "n": np.repeat([len(h) for h in hashes], each),
                   "place": np.concatenate([m[0] for m in met]), "at": np.concatenate([m[1] for m in met]),
                   "longer": np.concatenate([m[2] for m in met])}
    with recorded(passed := []):
        every = settle(through_arrow(texts, rank, "key long, n int, place long, at int, longer boolean", keeps="word hashes"), "ranked")
    both = every.groupBy("place").agg(
        F.count_if("longer").alias("y"), F.count_if(~F.col("longer")).alias("x"), F.min("key").alias("a"), F.max("key").alias("b"))
    met = settle(every.join(both.filter("x > 0 and y > 0 and a != b").select("place"), "place", "left_semi"), "places")
    drop(rows.sparkSession, passed)
    return met


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents that SimHash proposes; they connect all within ``RADIUS`` bits of each other."""
    firsts = settle(nodes.groupBy("fp").agg(F.min("key").alias("first")), "prints")
    equal = nodes.join(firsts, "fp").filter("key != first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    ends = firsts.select(F.col("fp").alias("b"), F.col("first").alias("other"))
    near = hamming_links(firsts.select("fp"), RADIUS).join(firsts.withColumnRenamed("fp", "a"), "a").join(ends, "b")
    return equal.union(near.select("first", "other"))


def _links(nodes: DataFrame, rows: DataFrame, row: str, least: float, width: int) -> DataFrame:
    """Links (a, b) that connect all proposed pairs that are alike.

    Fingerprints are linked first; the bands add what they miss. A crowded bucket is linked to single members of it, as long as that joins much. The documents of those
    that are left in several components, say texts of one template, meet by their rare shingles instead,
    so the pairs held to texts grow with those that are nearly alike, not with the bucket.
    """
    seen: list[DataFrame] = []

    def hold(pairs: DataFrame) -> DataFrame:
        return _alike(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")),
                      rows, row, least, width, seen)

    def still_open(crowd: DataFrame, below: DataFrame) -> tuple[DataFrame, int]:
        """Members of places with several components, with their component and the largest there."""
        with recorded(passed := []):
            members = settle(crowd.join(below.withColumnRenamed("node", "key"), "key", "left").withColumn(
                "root", F.coalesce("root", "key")), "members")
            parts = settle(members.groupBy("place", "root").agg(F.count("*").alias("c")).groupBy("place").agg(
                F.count("*").alias("roots"), F.max_by("root", F.struct("c", "root")).alias("largest")).filter("roots > 1"), "open")
            left = settle(members.join(parts.select("place", "largest"), "place"), "crowd")
        roots = parts.agg(F.sum("roots")).first()[0] or 0
        drop(rows.sparkSession, passed[:-1])
        return left, roots

    def stars(crowd: DataFrame, links: DataFrame, hubs: Column, fit: Column) -> tuple[DataFrame, DataFrame | None]:
        """Links after turns of one hub per place, and what is still open, if anything.

        The links given back lead each document to the root of its component; a turn adds to those of the turn before.
        """
        turn, before = 0, None
        passed: list[str] = []  # folders of the turn before
        while True:
            with recorded(rooted := []):
                below = below_roots(links)
            with recorded(own := []):
                left, parts = still_open(crowd, below)
            drop(rows.sparkSession, passed)
            links = below.toDF("a", "b")
            if not parts:
                return links, None
            if before is not None and parts > 0.9 * before:
                return links, left
            order = F.struct(F.when(F.lit(turn == 0), F.col("n")), F.xxhash64("key", F.lit(turn)))
            held = left.filter(hubs).groupBy("place").agg(F.min_by(F.struct(*left.columns), order).alias("x"))
            with recorded(passed):
                hubs_held = settle(held, "hubs")
            star = left.select("place", F.struct(*left.columns).alias("y")).join(hubs_held, "place").filter(
                "x.root != y.root").filter(fit).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
            found = hold(star)
            if found.isEmpty():
                return links, left  # nothing that the next turn would find otherwise
            links = links.union(found)
            crowd, turn, before = left.drop("root", "largest"), turn + 1, parts
            passed += [own[-1], *rooted]

    alike = hold(_by_fingerprint(nodes))
    entries = nodes.select("key", "n", F.posexplode("bands").alias("band", "value")).select(
        "key", "n", F.xxhash64("band", "value").alias("place"))
    size = settle(entries.groupBy("place").agg(F.count("*").alias("held")).filter("held > 1"), "buckets")
    met = settle(entries.join(size, "place").withColumn("crowded", F.col("held") - 1 > 2 * SHARE), "met")
    few = met.filter("not crowded").select("place", F.struct("key", "n").alias("x"))
    close = F.expr(f"least(x.n, y.n) >= {least!r} * greatest(x.n, y.n)")
    links = alike.union(hold(few.join(few.withColumnRenamed("x", "y"), "place").filter("x.key < y.key").filter(close).select(
        F.col("x.key").alias("a"), F.col("y.key").alias("b"))))
    links, crowd = stars(met.filter("crowded").select("place", "key", "n"), links, F.lit(True), close)
    if crowd is None:
        return links

    enough = _needed(least, F.col("x.n"), F.col("y.n"))
    fit = F.expr("not x.longer and y.longer and x.n <= y.n") & (
        F.least(F.expr("x.n - x.at"), F.expr("y.n - y.at")) >= enough)
    links, crowd = stars(_ranked(crowd, rows, row, least, width), links, ~F.col("longer"), fit)
    if crowd is None:
        return links
    # Members of the largest component of a place meet those of others only.
    x = crowd.filter("not longer").select("place", F.struct(*crowd.columns).alias("x"))
    y = crowd.filter("longer").select("place", F.struct(*crowd.columns).alias("y"))
    rest = x.filter("x.root != x.largest").join(y, "place").union(
        x.filter("x.root = x.largest").join(y.filter("y.root != y.largest"), "place"))
    return links.union(hold(rest.filter("x.root != y.root").filter(fit).select(
        F.col("x.key").alias("a"), F.col("y.key").alias("b"))))


def one_of_each(docs: DataFrame, least: float = 0.8, width: int = 5) -> DataFrame:
    """The document with the least doc_id of each group of near copies, all columns.

    Near copies have at least this Jaccard similarity of their ``width``-word shingles, or are
    connected by such pairs. Documents with the same shingles are one node, those without words
    too. Equal ids: any one row; a null id comes after all others.
    """
    row = free_name(docs, "_row")
    rows = numbered(docs, row)
    signed = _signed(rows, row, width)
    ids = rows.select(F.col(row).alias("key"), "doc_id")
    classes = settle(signed.select("key", "same").join(ids, "key").groupBy("same").agg(
        F.min("key").alias("node"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
        .alias("first")), "classes")
    nodes = settle(signed.join(classes.select(F.col("node").alias("key")), "key", "left_semi"), "nodes")
    roots = below_roots(_links(nodes, rows, row, least, width))
    stay = classes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(
        F.min("first").alias("first")).select(F.col("first.key").alias(row))
    return rows.join(stay, row, "left_semi").drop(row)
