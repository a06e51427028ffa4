"""Best-fit decreasing packing of token sequences, over all documents at once.

Which bin a piece goes to depends on its length alone, and there are at most ``size`` lengths. So the
driver packs the histogram: runs of pieces of one length into runs of bins with the same room, the
tightest first. Tasks number their pieces by length, and look up run and bin by that number.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeq.llm.common import Batches, chunks, settle, through_arrow, whole_text
from codeq.llm.subwords import word_encoder

KNOWN_WORDS = 250_000
PIECES = ("doc_id long, piece int, start long, length int, ids_crc32 long, ids binary, "
          "task int, place long")


class RoomTree:
    """Segment tree over room 0..size: the least room that some open bin has, from a bound on."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.filled = bytearray(2 * self.leaves)

    def mark(self, room: int, filled: bool) -> None:
        node = room + self.leaves
        self.filled[node] = filled
        while node > 1:
            node //= 2
            self.filled[node] = self.filled[2 * node] | self.filled[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        node = least + self.leaves
        if self.filled[node]:
            return least
        while node > 1 and (node % 2 or not self.filled[node + 1]):
            node //= 2
        if node <= 1:
            return None
        node += 1
        while node < self.leaves:
            node = 2 * node + (not self.filled[2 * node])
        return node - self.leaves


def best_fit(histogram: dict[int, int], size: int) -> tuple[np.ndarray, int]:
    """Pack so many pieces of each length; returns the runs and the number of bins.

    A run is (length, first place, first bin, pieces to a bin, offset in it). How many there are
    depends on ``size``, not on the number of pieces: a run ends a length, or uses up a run of bins.
    """
    tree, rooms, runs, bins = RoomTree(size), defaultdict(list), [], 0

    def put(room: int, first: int, count: int) -> None:
        if count and room:
            rooms[room].append((first, count))
            tree.mark(room, True)

    for length in sorted(histogram, reverse=True):
        place, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, per_bin = size, size // length
                first, count = bins, -(-left // per_bin)
                bins += count
            else:
                per_bin = room // length
                first, count = rooms[room].pop()
                if not rooms[room]:
                    tree.mark(room, False)
            taken = min(left, count * per_bin)
            full, rest = divmod(taken, per_bin)
            runs.append((length, place, first, per_bin, size - room))
            put(room - per_bin * length, first, full)
            put(room - rest * length, first + full, int(rest > 0))
            put(room, first + full + (rest > 0), count - full - (rest > 0))
            place, left = place + taken, left - taken
    return np.array(runs, dtype=np.int64).reshape(-1, 5), bins


def token_pieces(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0,
                 with_ids: bool = True) -> DataFrame:
    """Documents as ids with an end id, cut every ``size`` ids, with a number among their length.

    Null text is empty; a null or repeated ``doc_id`` is kept as it is, row by row. ``ids``: unsigned
    32-bit little-endian, null unless wanted.
    """
    def cut(batches: Batches):
        encoder, end = word_encoder(vocabulary, False, KNOWN_WORDS), end_id.to_bytes(4, "little")
        seen, task, width = defaultdict(int), TaskContext.get().partitionId(), 4 * size
        for doc_ids, texts in chunks(batches, "doc_id", "text"):
            rows = defaultdict(list)
            for doc_id, ids in zip(doc_ids, encoder.encode(texts), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at:at + width]
                    length = len(part) // 4
                    for name, value in (
                            ("doc_id", doc_id), ("piece", piece), ("start", at // 4),
                            ("length", length), ("ids_crc32", zlib.crc32(part)),
                            ("ids", part if with_ids else None), ("task", task),
                            ("place", seen[length])):
                        rows[name].append(value)
                    seen[length] += 1
            yield rows
    return through_arrow(docs.select("doc_id", whole_text()), cut, PIECES, keeps=vocabulary)


def pack(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """Pieces (``length``, ``task``, ``place``; from a written table) with sequence_id and offset.

    Every length is 1 to ``size``. The whole table is packed as one, so at most one bin is left
    that a sequential best-fit decreasing would not have.
    """
    counts = settle(pieces.groupBy("task", "length").agg((F.max("place") + 1).alias("n")), "counts")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(
        Window.unboundedPreceding, -1)
    # Written down, so that the join deals pieces out by task and length, not by length alone.
    shifts = settle(counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")),
                    "shifts")
    histogram = {r["length"]: r["n"] for r in
                 counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = best_fit(histogram, size)
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    runs = runs[order]
    keys = (runs[:, 0] << 48) + runs[:, 1]

    def look_up(batches: Batches) -> Batches:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            place = batch.column("place").to_numpy(zero_copy_only=False)
            _, first, first_bin, per_bin, used = runs[
                np.searchsorted(keys, (length << 48) + place, side="right") - 1].T
            nth = place - first
            sequence, offset = first_bin + nth // per_bin, used + nth % per_bin * length
            kept = [batch.column(c) for c in batch.schema.names if c not in ("task", "place")]
            names = [c for c in batch.schema.names if c not in ("task", "place")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    placed = pieces.join(shifts, ["task", "length"]).withColumn(
        "place", F.col("place") + F.col("shift")).select(*pieces.columns)
    kept = [f for f in placed.schema if f.name not in ("task", "place")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return placed.mapInArrow(look_up, f"{schema}, sequence_id long, offset long")


def packed_pieces(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0,
                  with_ids: bool = True) -> DataFrame:
    """Tokenise, cut and pack documents; one row per piece."""
    return pack(settle(token_pieces(docs, vocabulary, size, end_id, with_ids), "pieces"), size)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids, at most ``size`` of them each."""
    held = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.aggregate(held, F.lit(b""), lambda done, x: F.concat(done, x["ids"])).alias("ids"))
