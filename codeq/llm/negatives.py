"""Hard negatives for anchors: rows of other labels that score close to a positive, but below it.

Vectors are rotated and kept as one bit per component, with their length and how far they go along their
own code. The score of two vectors is then known up to an interval: the codes' agreement, counted in bits,
times both alignments, and what the parts beside the codes may add by the Cauchy-Schwarz inequality. Only
pairs whose interval reaches into what is still wanted are scored, in whole numbers.

Anchors are taken in blocks of bounded size, each against all rows. Tasks keep the best rows of every
anchor, so what is shuffled per block are a few rows per anchor and task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeq.llm.common import settle, through_arrow

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
# A negative scores LEAST to MOST hundredths of its positive's score.
LEAST, MOST = 30, 90
BLOCK_VALUES = 1 << 20  # components of one block of anchors: 8 MB to every executor
PAIRS = 1 << 20  # pairs that a task looks at together
SEED = 20_240_101
# Squared length that a vector of whole numbers must stay below, so that scores fit 63 bits and sums of
# doubles are exact to far less than the margin of the intervals.
LONGEST = float(1 << 52)
MARGIN = 1e-9  # of the product of both lengths: more than rounding can amount to


def whole_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label and ``q``, the vector as whole numbers, of the rows that take part.

    Rows without a label or a vector, or with a component that is null or not finite, take no part. A
    component x becomes floor(256 x).
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    kept = rows.filter(F.col("label").isNotNull() & F.col(vector).isNotNull() & finite)
    length = F.aggregate(f"{vector}", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x.cast("double") * SCALE).cast("double"), 2))
    q = F.when(length < LONGEST, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))).otherwise(
        F.raise_error(F.concat(F.lit("a vector is too long for whole scores: "), F.col("vec_id").cast("string")))
        .cast("array<bigint>"))
    return kept.select("vec_id", "label", q.alias("q"))


def relabelled(rows: DataFrame) -> DataFrame:
    """The rows with the label (label + 1) % 10 where vec_id is divisible by 7."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, ((F.col("label") + 1) % 10).cast("int"))
                           .otherwise(F.col("label")))


def rotation(size: int) -> np.ndarray:
    """A fixed random rotation."""
    turned, upper = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, size)))
    return turned * np.sign(np.diag(upper))


@dataclass
class Codes:
    """One-bit codes of rotated vectors, with what is known of the vectors beside them."""

    bits: np.ndarray  # (rows, words of 64 bits)
    along: np.ndarray  # length of the part along the code
    beside: np.ndarray  # length of the rest
    size: int

    @classmethod
    def of(cls, q: np.ndarray, turn: np.ndarray) -> Codes:
        turned = q @ turn
        size = max(q.shape[1], 1)
        packed = np.packbits(turned > 0, axis=1)
        packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
        along = np.abs(turned).sum(axis=1) / math.sqrt(size)
        beside = np.sqrt(np.maximum((q * q).sum(axis=1) - along * along, 0))
        return cls(np.ascontiguousarray(packed).view(np.uint64), along, beside, size)

    def take(self, part: slice) -> Codes:
        return Codes(self.bits[part], self.along[part], self.beside[part], self.size)

    def intervals(self, others: Codes) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores of these vectors with others, whatever lies beside the codes.

        With the codes c, d at cosine t, x = a c + r and y = b d + s, the score is a b t + a c.s + b d.r + r.s.
        As r is square to c, |d.r| is at most |r| sqrt(1 - t^2); so for c.s; and |r.s| is at most |r| |s|.
        """
        apart = np.zeros((len(self.along), len(others.along)), dtype=np.int64)
        for word in range(self.bits.shape[1]):
            apart += np.bitwise_count(self.bits[:, word, None] ^ others.bits[None, :, word])
        cosine = 1 - 2 * apart / self.size
        across = np.sqrt(np.maximum(1 - cosine * cosine, 0))
        middle = np.multiply.outer(self.along, others.along)
        lengths = np.multiply.outer(np.hypot(self.along, self.beside), np.hypot(others.along, others.beside))
        wide = (across * (np.multiply.outer(self.along, others.beside) + np.multiply.outer(self.beside, others.along))
                + np.multiply.outer(self.beside, others.beside) + MARGIN * lengths)
        wide = np.minimum(wide, lengths * (1 + MARGIN) + np.abs(middle * cosine))
        return np.maximum(middle * cosine - wide, -lengths * (1 + MARGIN)), np.minimum(
            middle * cosine + wide, lengths * (1 + MARGIN))


def _matrix(vectors: list, size: int) -> np.ndarray:
    """Vectors as rows of doubles, which hold them exactly; a shorter one has zeros at its end."""
    out = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


class Best:
    """The first rows of each list by falling score, then id (nulls last), then row."""

    def __init__(self, lists: int, room: int):
        self.kept: list[list[tuple]] = [[] for _ in range(lists)]
        self.room = room
        self.least = np.full(lists, -np.inf)  # a row below it is not among the first, as far as is known

    def add(self, which: np.ndarray, scores: np.ndarray, ids: list, rows: np.ndarray) -> None:
        order = np.argsort(which, kind="stable")
        which, scores, rows = which[order], scores[order], rows[order]
        cuts = np.flatnonzero(np.diff(which)) + 1
        for part in np.split(np.arange(len(which)), cuts) if len(which) else []:
            i = int(which[part[0]])
            if len(part) > 4 * self.room:  # whole ties of the last place stay
                edge = np.partition(scores[part], len(part) - self.room)[len(part) - self.room]
                part = part[scores[part] >= edge]
            new = [(-int(scores[j]), ids[order[j]] is None, ids[order[j]] or 0, int(rows[j])) for j in part]
            self.kept[i] = sorted(self.kept[i] + new)[:self.room]
            if len(self.kept[i]) == self.room:
                self.least[i] = -self.kept[i][-1][0]

    def columns(self, first: int = 0) -> dict[str, list]:
        out = {n: [] for n in ("list", "score", "vec_id", "row")}
        for i, kept in enumerate(self.kept):
            for score, null, vec_id, row in kept:
                for n, v in zip(out, (first + i, -score, None if null else vec_id, row), strict=True):
                    out[n].append(v)
        return out


def _first(found: DataFrame, room: int) -> DataFrame:
    """The first rows of each list over all tasks, with their rank."""
    order = Window.partitionBy("list").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= room)


def _stream(rows: DataFrame, handle, room: int, lists: int, bits: int) -> DataFrame:
    """Rows through ``handle(best, labels, ids, numbers, q)`` in small parts; the first of every list."""
    def run(batches):
        best = Best(lists, room)
        for batch in batches:
            for low in range(0, batch.num_rows, bits):
                part = batch.slice(low, bits)
                handle(best, part.column("label").to_numpy(zero_copy_only=False), part.column("vec_id").to_pylist(),
                       part.column("row").to_numpy(zero_copy_only=False), part.column("q").to_pylist())
        yield best.columns()
    return _first(through_arrow(rows, run, "list int, score long, vec_id long, row long"), room)


def _numbered_anchors(rows: DataFrame, is_anchor: Column, size: int) -> tuple[DataFrame, int]:
    """The anchors with a ``block`` of at most BLOCK_VALUES components, and how many blocks there are.

    Only the number of anchors in each written part comes to the driver.
    """
    anchors = settle(rows.filter(is_anchor).withColumn("at", F.monotonically_increasing_id()), "anchors")
    part = F.shiftright("at", 33)
    counts = {r["part"]: r["n"] for r in anchors.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    room = max(1, BLOCK_VALUES // max(size, 1))
    before, total = {}, 0
    for p in sorted(counts):
        before[p], total = total, total + counts[p]
    starts = F.create_map(*[F.lit(x) for p in before for x in (p, before[p])]) if before else F.create_map(F.lit(0), F.lit(0))
    number = F.element_at(starts, part.cast("int")) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = anchors.withColumn("block", F.floor(number / room).cast("int")).drop("at")
    return settle(numbered, "blocks"), math.ceil(total / room)


def mined(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
          least: int = LEAST, most: int = MOST) -> DataFrame:
    """Hard negatives of each anchor and each of its positives.

    ``rows`` has vec_id, label and q, as ``whole_vectors`` gives them; its other columns are not looked at. An
    anchor's positives are the first other rows of its label; the negatives of a positive the first rows of other
    labels that score ``least`` to ``most`` hundredths of its score. First are higher scores, then smaller
    vec_ids, null ones last. Repeated rows and ids count as rows of their own: a copy of an anchor is another
    row, and an anchor for itself, whose lists come again. Of vectors of two sizes the shorter ends in zeros.
    An empty table, or one without anchors, gives no rows.

    Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = rows.sparkSession
    rows = settle(rows.select("vec_id", "label", "q", F.monotonically_increasing_id().alias("row")), "vectors")
    size = rows.agg(F.max(F.size("q"))).first()[0] or 0
    turn, anchors, total = rotation(size), *_numbered_anchors(rows, is_anchor, size)
    out = None
    for block in range(total):
        found = _mined_block(rows, anchors.filter(F.col("block") == block), turn, positives, negatives, least, most)
        path_of = settle(found, "mined")
        out = path_of if out is None else out.union(path_of)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame([], schema) if out is None else out


def _mined_block(rows: DataFrame, anchors: DataFrame, turn: np.ndarray, positives: int, negatives: int,
                 least: int, most: int) -> DataFrame:
    spark, size = rows.sparkSession, len(turn)
    own = anchors.orderBy("row").toPandas()  # at most BLOCK_VALUES components
    vectors = _matrix(own["q"].tolist(), size)
    held = spark.sparkContext.broadcast((vectors, own["label"].to_numpy(), own["row"].to_numpy()))
    part = max(1, PAIRS // max(len(own), 1))

    def alike(best, labels, ids, numbers, q):
        vectors, own_labels, own_rows = held.value
        mine = _codes(vectors, turn)
        q = _matrix(q, size)
        _, high = mine.intervals(Codes.of(q, turn))
        maybe = ((own_labels[:, None] == labels[None, :]) & (own_rows[:, None] != numbers[None, :])
                 & (high >= best.least[:, None]))
        i, j = np.nonzero(maybe)
        scores = np.einsum("ij,ij->i", vectors[i], q[j]).astype(np.int64)
        best.add(i, scores, [ids[x] for x in j], numbers[j])
    chosen = settle(_stream(rows, alike, positives, len(own), part), "positives")
    pairs = chosen.orderBy("list", "rank").toPandas()  # ``positives`` rows of two numbers per anchor of the block
    of = pairs["list"].to_numpy(dtype=np.int64)
    score = pairs["score"].to_numpy(dtype=np.int64)
    # 100 n >= least p and 100 n <= most p in whole numbers
    low, high = -((-least * score) // 100), (most * score) // 100
    told = spark.sparkContext.broadcast((of, low, high))

    def unlike(best, labels, ids, numbers, q):
        vectors, own_labels, _ = held.value
        of, low, high = told.value
        mine = _codes(vectors, turn)
        q = _matrix(q, size)
        lower, upper = mine.intervals(Codes.of(q, turn))
        other = own_labels[:, None] != labels[None, :]
        # A pair of an anchor and a row is scored once, for whichever of its positives it may be wanted.
        wanted = np.zeros(other.shape, dtype=bool)
        need = np.maximum(low, best.least)
        for k in range(positives):
            turns = np.flatnonzero(place == k)
            a = of[turns]
            wanted[a] |= other[a] & (upper[a] >= need[turns, None]) & (lower[a] <= high[turns, None])
        i, j = np.nonzero(wanted)
        scores = np.einsum("ij,ij->i", vectors[i], q[j]).astype(np.int64)
        for k in range(positives):
            turns = np.flatnonzero(place == k)
            slot = np.full(len(vectors), -1)
            slot[of[turns]] = turns
            mine_of = slot[i]
            fits = (mine_of >= 0) & (scores >= low[mine_of]) & (scores <= high[mine_of]) & (scores >= best.least[mine_of])
            best.add(mine_of[fits], scores[fits], [ids[x] for x in j[fits]], numbers[j[fits]])
    place = (pairs["rank"].to_numpy(dtype=np.int64) - 1)
    if not len(pairs):
        place, of = np.zeros(0, np.int64), np.zeros(0, np.int64)
    negatives_of = _stream(rows, unlike, negatives, len(pairs), part)
    names = spark.createDataFrame(
        [(i, _whole(own["vec_id"].iloc[a]), _whole(p), int(s)) for i, (a, p, s) in enumerate(
            zip(of, pairs["vec_id"], score, strict=True))],
        "list int, anchor_id long, positive_id long, positive_score long")
    return negatives_of.join(names, "list").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def _whole(x) -> int | None:
    return None if x is None or x != x else int(x)


_last: dict[int, tuple[np.ndarray, Codes]] = {}


def _codes(vectors: np.ndarray, turn: np.ndarray) -> Codes:
    """The codes of a block's anchors, found once by a worker as long as it works on that block."""
    if not _last or next(iter(_last.values()))[0] is not vectors:
        _last.clear()
        _last[0] = vectors, Codes.of(vectors, turn)
    return _last[0][1]


SQL = f"""
WITH kept AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS q,
           row_number() OVER () AS row
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, a.row AS anchor, r.vec_id, r.row, a.label = r.label AS alike,
           coalesce(list_sum(list_transform(list_zip(a.q, r.q), lambda p: p[1] * p[2])), 0)::BIGINT AS score
    FROM kept a JOIN kept r ON a.row <> r.row WHERE a.vec_id % 100 = 0),
positives AS (
    SELECT anchor_id, anchor, vec_id AS positive_id, score AS positive_score,
           row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS n
    FROM scored WHERE alike QUALIFY n <= {POSITIVES}),
ranked AS (
    SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor, p.n ORDER BY s.score DESC, s.vec_id)::INT AS rank
    FROM positives p JOIN scored s ON s.anchor = p.anchor AND NOT s.alike
    WHERE {LEAST} * positive_score <= 100 * s.score AND 100 * s.score <= {MOST} * positive_score
    QUALIFY rank <= {NEGATIVES})
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked
"""
