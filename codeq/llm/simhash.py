"""SimHash near-duplicates by the general pigeonhole principle.

64 bits are grouped into m parts and ``radius - m + 1`` distance is shared out among them as
thresholds of -1 (the part is not looked at), 0, 1, ...: two fingerprints within the radius are
within its threshold in at least one part. Correlated bits go to the same part, so that chance
agreement is concentrated there, and a dynamic programme over all parts gives each its threshold so
that index entries, probes and expected candidates cost least.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeq.llm.common import chunks, free_name, numbered, settle, through_arrow, whole_text
from codeq.llm.components import below_roots

BITS = 64
VERIFY = 0.3  # cost of a candidate, in index entries
SHARE = 64  # a bucket is compared pair by pair up to so many pairs per entry
BLOCK = 1 << 16


def fingerprint(text: str, width: int = 3) -> int:
    """Bits that are set in more than half of the shingles' XXH64 (seed 42); zero without words.

    Words are split at ASCII white space after lower-casing A-Z; a text of fewer words than
    ``width`` is one shingle.
    """
    from xxhash import xxh64_intdigest
    words = text.encode().lower().split()
    if not words:
        return 0
    count, ones = max(1, len(words) - width + 1), np.zeros(BITS, dtype=np.int64)
    for start in range(0, count, BLOCK):
        held = words[start:start + BLOCK + width - 1]
        joined = b" ".join(held)
        ends = np.cumsum([len(w) + 1 for w in held]) - 1
        starts = np.concatenate([[0], ends + 1])
        hashes = np.fromiter(
            (xxh64_intdigest(joined[a:b], 42)
             for a, b in zip(starts.tolist(), ends[min(width, len(held)) - 1:].tolist())),
            dtype=np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", width: int = 3) -> DataFrame:
    """(key, fp) of every row; null text is empty, fp a signed 64-bit integer."""
    def rows(batches):
        for keys, texts in chunks(batches, "key", "text"):
            prints = np.array([fingerprint(t, width) for t in texts], dtype=np.uint64)
            yield {"key": keys, "fp": prints.view(np.int64)}
    return through_arrow(docs.select(F.col(key).alias("key"), whole_text()), rows, "key long, fp long")


def _bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and in how many of them bits i and j are both set."""
    def partial(batches):
        total, both = 0, np.zeros((BITS, BITS), dtype=np.int64)
        for batch in batches:
            values = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint8)
            for at in range(0, len(values), 8 * BLOCK):
                bits = np.unpackbits(values[at:at + 8 * BLOCK].reshape(-1, 8), axis=1,
                                     bitorder="little").astype(np.float32)
                both += (bits.T @ bits).astype(np.int64)
                total += len(bits)
        i, j = np.indices(both.shape)
        yield {"i": np.append(i.ravel(), -1), "j": np.append(j.ravel(), -1),
               "n": np.append(both.ravel(), total)}
    sums = through_arrow(fps.select("fp"), partial, "i int, j int, n long").groupBy("i", "j").agg(
        F.sum("n").alias("n")).collect()  # 4097 rows
    both, total = np.zeros((BITS, BITS)), 0
    for r in sums:
        if r["i"] < 0:
            total = r["n"]
        else:
            both[r["i"], r["j"]] = r["n"]
    return total, both


def _grouped(both: np.ndarray, total: int, parts: int) -> list[list[int]]:
    """Bits in groups of nearly equal size, each grown by the bit most correlated with it."""
    share = np.diag(both) / total
    spread = np.sqrt(share * (1 - share))
    scale = np.outer(spread, spread)
    alike = np.abs(np.divide(both / total - np.outer(share, share), scale,
                             out=np.zeros_like(scale), where=scale > 0))
    np.fill_diagonal(alike, 0)
    free, groups = list(range(BITS)), []
    for left in range(parts, 0, -1):
        size = -(-len(free) // left)
        group = [max(free, key=lambda b: (alike[b, free].sum(), -b))]
        while len(group) < size:
            rest = [b for b in free if b not in group]
            group.append(max(rest, key=lambda b: (alike[b, group].sum(), -b)))
        free = [b for b in free if b not in group]
        groups.append(sorted(group))
    return groups


def _mask(bits: tuple[int, ...] | list[int]) -> int:
    """The bits as a signed 64-bit integer."""
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _distances(bits: list[int], both: np.ndarray, total: int, most: int) -> np.ndarray:
    """Share of random pairs that differ in 0..most of these bits, as if bits were independent."""
    out = np.zeros(most + 1)
    out[0] = 1
    for b in bits:
        p = both[b, b] / total
        differ = 2 * p * (1 - p)
        out[1:], out[0] = out[1:] * (1 - differ) + out[:-1] * differ, out[0] * (1 - differ)
    return out


def _allocate(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """Share out ``units`` so that the costs (part, units given) add up to least."""
    best = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, given) in best.items():
            for more in range(min(len(row) - 1, units - used) + 1):
                found = (cost + row[more], [*given, more])
                if used + more not in step or found < step[used + more]:
                    step[used + more] = found
        best = step
    return best[units]


def thresholds(fps: DataFrame, radius: int = 2) -> list[tuple[int, list[int], int]]:
    """(part, bits, threshold) of the parts to look at, for a table of distinct fingerprints."""
    total, both = _bit_statistics(fps)
    if total < 2:
        return []
    layouts = [_grouped(both, total, m) for m in range(2, radius + 3)]
    flat = [bits for layout in layouts for bits in layout]
    parts = F.explode(F.array(*[
        F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("value"))
        for i, bits in enumerate(flat)])).alias("x")
    met = {r["part"]: r["pairs"] for r in
           fps.select(parts).groupBy("x.part", "x.value").count().groupBy("part").agg(
               F.sum(F.col("count") * (F.col("count") - 1.0) / 2).alias("pairs")).collect()}

    def costs(i: int, bits: list[int]) -> list[float]:
        """With 0, 1, ... units, that is with a threshold of -1, 0, ..."""
        share = _distances(bits, both, total, radius)
        within = np.cumsum(share) / max(share[0], 1e-300)
        row, probes = [0.0], 0
        for t in range(radius + 1):
            probes += comb(len(bits), t)
            row.append(total * (1 + probes * (t > 0)) + VERIFY * met[i] * within[t])
        return row

    plans, at = [], 0
    for layout in layouts:
        cost, units = _allocate([costs(at + k, b) for k, b in enumerate(layout)], radius + 1)
        plans.append((cost, [(k, b, u - 1) for k, (b, u) in enumerate(zip(layout, units)) if u]))
        at += len(layout)
    return min(plans, key=lambda p: p[0])[1]


def _near(a: str, b: str, radius: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius


def _crowded_links(crowd: DataFrame, radius: int) -> DataFrame:
    """Links among fingerprints of crowded buckets, without comparing pairs.

    Two are within two bits when they have a neighbour at one bit, or themselves, in common, and
    within one when they agree but for some one bit. So each goes to its 65 neighbours, or to itself
    without each bit, and is linked to the least fingerprint there.
    """
    fp = F.col("fp")
    if radius == 2:
        around = [fp, *[fp.bitwiseXOR(F.lit(_mask([b]))) for b in range(BITS)]]
        places = [F.struct(F.lit(0).alias("bit"), x.alias("at")) for x in around]
    else:
        places = [F.struct(F.lit(b).alias("bit"), fp.bitwiseAND(F.lit(_mask([c for c in range(BITS) if c != b])))
                           .alias("at")) for b in range(BITS)]
    near = crowd.select("fp", F.explode(F.array(*places)).alias("place")).select("fp", "place.bit", "place.at")
    least = near.groupBy("bit", "at").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    return near.join(least.drop("n"), ["bit", "at"]).filter("fp != a").select(
        "a", F.col("fp").alias("b")).distinct()


def hamming_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``radius`` (at most 2) of each other.

    ``fps``: a written table of distinct ``fp``. Each link is between two within the radius, and all
    such pairs are connected by links. A bucket with up to ``SHARE`` pairs per entry gives its
    verified pairs, a larger one gives links over common neighbours, so work stays linear in it.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    plan = thresholds(fps, radius) if radius else []  # fingerprints are distinct
    if not plan:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)

    def entries(part: int, bits: list[int], flips: list[int]) -> Column:
        value = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        return F.array(*[F.struct(F.lit(part).alias("part"),
                                  value.bitwiseXOR(F.lit(f)).alias("value")) for f in flips])

    def of(kind: list[Column]) -> DataFrame:
        if not kind:
            return fps.select(F.lit(0).alias("part"), F.col("fp").alias("value"), "fp").limit(0)
        return fps.select("fp", F.explode(F.concat(*kind)).alias("x")).select("x.part", "x.value", "fp")

    index = of([entries(k, bits, [0]) for k, bits, _ in plan])
    probes = of([entries(k, bits, [_mask(c) for d in range(1, t + 1) for c in combinations(bits, d)])
                 for k, bits, t in plan if t > 0])
    key = ["part", "value"]
    both = index.withColumn("probe", F.lit(0)).unionByName(probes.withColumn("probe", F.lit(1)))
    size = both.groupBy(*key).agg(F.sum(1 - F.col("probe")).alias("s"), F.sum("probe").alias("p"))
    pairs = F.col("s") * (F.col("s") - 1) / 2 + F.col("s") * F.col("p")
    size = settle(size.filter("s > 0 and s + p > 1").select(
        *key, (pairs > SHARE * (F.col("s") + F.col("p"))).alias("crowded")), "buckets")
    met = settle(both.join(size, key), "met")
    loose = met.filter("not crowded")
    inside = loose.filter("probe = 0").select(*key, F.col("fp").alias("a"))
    other = loose.select(*key, F.col("fp").alias("b"), "probe")
    links = [inside.join(other, key).filter(_near("a", "b", radius)).filter(
        "a < b or (probe = 1 and a != b)").select("a", "b")]
    if not size.filter("crowded").isEmpty():
        links.append(_crowded_links(met.filter("crowded").select("fp").distinct(), radius))
    return reduce(DataFrame.union, links)


def _components_of(prints: DataFrame, ids: list[Column], radius: int) -> DataFrame:
    """(fp, first) with the least of ``ids`` in the component of each fingerprint."""
    classes = settle(prints.groupBy("fp").agg(F.min(F.struct(*ids)).alias("first")), "classes")
    roots = below_roots(hamming_links(classes.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = settle(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = settle(rooted.groupBy("root").agg(F.min("first").alias("least")), "least")
    return rooted.join(least, "root").select("fp", F.col("least").alias("first"))


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (least doc_id reachable).

    Documents with equal fingerprints are one node; null text is empty (fingerprint zero). Rows with
    a null doc_id take part; a component of such rows alone has a null id. Repeated rows stay.
    """
    prints = settle(fingerprints(docs, width=width), "prints")
    found = _components_of(prints, [F.col("key").isNull().alias("none"), F.col("key")], radius)
    return prints.join(found, "fp").select(
        F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("first.key").alias("component_id"))


def one_of_each(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """The document with the least doc_id of each component, all columns; equal ids: any one row."""
    row = free_name(docs, "_row")
    docs = numbered(docs, row)
    prints = settle(fingerprints(docs, row, width).join(
        docs.select(F.col(row).alias("key"), "doc_id"), "key"), "prints")
    found = _components_of(prints, [F.col("doc_id").isNull().alias("none"), F.col("doc_id"),
                                    F.col("key")], radius)
    stay = found.select(F.col("first.key").alias(row)).distinct()
    return docs.join(stay, row, "left_semi").drop(row)
