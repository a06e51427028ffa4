"""Shards of nearly equal bytes by sampled splitters.

Records are in the order of a key. A sample of keys, drawn by size, gives splitters; the ranges
between them are measured exactly, and overfull ones are sampled and split again. Shards are runs of
ranges. A range that the boundary of a shard falls into is split at the exact byte: its groups of equal
texts are dealt to both sides, the largest first, to where most room is left. A group goes whole unless
it would overfill every side by more than a fiftieth of a shard; then its records are dealt one by one.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeq.llm.common import free_name, settle

SAMPLES = 50_000  # keys drawn for splitters; bounds what comes to the driver
MOST_RANGES = 4000
ROUNDS = 3
OVERFULL = 0.02  # of a shard: what each of its two boundaries may add to it to keep a group whole


def _range_of(splitters: np.ndarray):
    """Column function: number of splitters (key, salt) at or before a record."""
    keys, salts = np.ascontiguousarray(splitters[:, 0]), np.ascontiguousarray(splitters[:, 1])

    @F.pandas_udf("int")
    def number(key: pd.Series, salt: pd.Series) -> pd.Series:
        key, salt = key.to_numpy(), salt.to_numpy()
        low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        out = low.copy()
        for k in np.unique(key[low < high]):  # keys that several ranges share
            own = key == k
            a, b = low[own][0], high[own][0]
            out[own] = a + np.searchsorted(salts[a:b], salt[own], "right")
        return pd.Series(out)
    return number


def _at_groups(splitters: np.ndarray) -> np.ndarray:
    """A key's only splitter moves to before its first record; a key of several fills ranges of its own."""
    keys, n = np.unique(splitters[:, 0], return_counts=True)
    only = np.isin(splitters[:, 0], keys[n == 1])
    return np.column_stack([splitters[:, 0], np.where(only, -1, splitters[:, 1])])


def _splitters(rows: DataFrame, total: int, ranges: int) -> np.ndarray:
    """Quantiles of a size-weighted sample of (key, salt), again inside ranges that are overfull."""
    drawn = np.zeros((0, 2), dtype=np.int64)
    inside, share, wanted = rows, total, ranges
    for turn in range(ROUNDS):
        rate = SAMPLES / max(share, 1)
        sample = inside.filter(F.rand(seed=turn) < F.col("size") * rate).select("key", "salt").limit(
            4 * SAMPLES).toArrow()
        found = np.column_stack([sample["key"].to_numpy(), sample["salt"].to_numpy()]).reshape(-1, 2)
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        at = np.linspace(0, len(found), wanted + 1)[1:-1].astype(np.int64)
        drawn = _at_groups(np.unique(np.vstack([drawn, found[at[at < len(found)]]]), axis=0))
        number = _range_of(drawn)
        ranged = rows.withColumn("range", number("key", "salt"))
        full = ranged.groupBy("range").agg(F.sum("size").alias("bytes")).filter(
            F.col("bytes") > 2 * total / ranges).orderBy(F.desc("bytes")).limit(MOST_RANGES).collect()
        if not full:
            break
        share = sum(r["bytes"] for r in full)
        wanted = max(2, min(MOST_RANGES - len(drawn), int(2 * ranges * share / total) + 1))
        inside = ranged.filter(F.col("range").isin([r["range"] for r in full])).drop("range")
    return drawn


def shard(docs: DataFrame, shards: int = 16, range_mb: int = 64,
          with_text: bool = True) -> DataFrame:
    """The rows with ``size`` (UTF-8 bytes of the text plus 1), ``shard`` and ``slot``.

    Shards are runs of one order, by a hash of the text and then by place in the table, but that
    records around a boundary change sides until both have their bytes, but for about the smallest
    of them. Slots count from 0 in that order. Null text has size 1 and equals empty text. Equal texts
    go to one shard unless together they are larger than a range (``range_mb``, or half a shard if
    that is less) or would overfill the shards around their boundary by more than a fiftieth. All columns that come in
    come out, but for the text if it isn't wanted; those named like new ones are replaced.
    """
    new = ("size", "shard", "slot", "key", "salt", "range", "segment", "turn", "rows_ahead", "first_shard")
    names = {c: free_name(docs, f"_{c}") if c.lower() in new else c for c in docs.columns
             if with_text or c != "text"}
    rows = settle(docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in names.items()],
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.monotonically_increasing_id().alias("salt")), "sized")
    return _cut(rows, shards, range_mb).select(
        *[F.col(f"`{n}`").alias(c) for c, n in names.items()
          if c.lower() not in ("size", "shard", "slot")],
        "size", "shard", "slot")


def _split(rows: pd.DataFrame, room: list[float], over: float = 0) -> np.ndarray:
    """Segment of each record (key, salt, size): the largest group first, each to where most room is.

    A group that overfills it by more than ``over`` is dealt record by record.
    """
    groups = pd.Series(np.arange(len(rows))).groupby(rows["key"].to_numpy()).indices
    sizes, salts = rows["size"].to_numpy(), rows["salt"].to_numpy()
    total = {key: int(sizes[at].sum()) for key, at in groups.items()}
    heap = [(-r, i) for i, r in enumerate(room)]
    heapq.heapify(heap)
    out = np.zeros(len(rows), dtype=np.int32)
    for key in sorted(groups, key=lambda k: (-total[k], k)):
        at = groups[key]
        left, i = heap[0]
        if total[key] <= over - left:
            out[at] = i
            heapq.heapreplace(heap, (left + total[key], i))
            continue
        for one in at[np.lexsort((salts[at], -sizes[at]))].tolist():
            left, i = heap[0]
            out[one] = i
            heapq.heapreplace(heap, (left + int(sizes[one]), i))
    return out


def _cut(rows: DataFrame, shards: int, range_mb: int) -> DataFrame:
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = int(max(2 * shards, min(MOST_RANGES, total / (range_mb << 20))))
    number = _range_of(_splitters(rows, total, ranges))
    placed = settle(rows.withColumn("range", number("key", "salt")), "ranges")
    sums = sorted(placed.groupBy("range").agg(F.sum("size")).collect())  # MOST_RANGES rows
    room, first_shard, ahead = {}, {}, 0
    for number, size in sums:
        low, high = ahead * shards // total, (ahead + size - 1) * shards // total
        edges = [ahead, *(total * k / shards for k in range(low + 1, high + 1)), ahead + size]
        first_shard[number] = low
        if high > low:
            room[number] = [b - a for a, b in zip(edges, edges[1:])]
        ahead += size
    # One group is one range, of about range_mb of text or 1/MOST_RANGES of it; at most a range per boundary.
    over = OVERFULL * total / shards
    dealt = placed.filter(F.col("range").isin(list(room))).select("range", "key", "salt", "size").groupBy(
        "range").applyInPandas(lambda x: x[["range", "salt"]].assign(
            segment=_split(x, room[int(x["range"].iloc[0])], over)), "range int, salt long, segment int")
    firsts = _table(placed, {"range": list(first_shard), "first_shard": list(first_shard.values())},
                    "range int, first_shard int")
    found = placed.join(dealt, ["range", "salt"], "left").join(F.broadcast(firsts), "range").select(
        "*", (F.col("first_shard") + F.coalesce("segment", F.lit(0))).alias("shard"))
    found = settle(found.withColumn("turn", F.row_number().over(
        Window.partitionBy("range", "shard").orderBy("key", "salt"))).drop("segment", "first_shard"), "turns")
    seen, filled = {"range": [], "shard": [], "rows_ahead": []}, defaultdict(int)
    for number, shard_no, n in sorted(found.groupBy("range", "shard").count().collect()):
        for name, value in zip(seen, (number, shard_no, filled[shard_no]), strict=True):
            seen[name].append(value)
        filled[shard_no] += n
    runs = _table(placed, seen, "range int, shard int, rows_ahead long")
    return found.join(F.broadcast(runs), ["range", "shard"]).withColumn(
        "slot", F.col("rows_ahead") + F.col("turn") - 1)


def _table(near: DataFrame, columns: dict[str, list], schema: str) -> DataFrame:
    return near.sparkSession.createDataFrame(list(zip(*columns.values(), strict=True)), schema)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write each shard to its own folder, in the order of slots; long shards as several files."""
    (sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
