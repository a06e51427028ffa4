"""Hard negatives against all pairs in plain Python; intervals hold every score."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeq.llm import negatives as n

COLUMNS = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """Sorted rows of the result, by the rules, one by one."""
    kept = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        kept.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = []
    for a, (anchor, label, q) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        others = [(-sum(x * y for x, y in zip(q, v, strict=False)), i is None, i or 0, b, own)
                  for b, (i, own, v) in enumerate(kept) if b != a]
        for p in sorted(x for x in others if x[4] == label)[:5]:
            fits = sorted(x for x in others if x[4] != label and 30 * -p[0] <= 100 * -x[0] <= 90 * -p[0])[:10]
            out += [(anchor, None if p[1] else p[2], k, None if x[1] else x[2], -p[0], -x[0])
                    for k, x in enumerate(fits, 1)]
    return sorted(map(str, out))


def mined(df):
    got = n.mined(n.whole_vectors(n.relabelled(df)), F.col("vec_id") % 100 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(str(tuple(r)) for r in got.collect())


@pytest.fixture(scope="module")
def odd_rows():
    dice = random.Random(8)
    centre = {label: [dice.gauss(0, 1) for _ in range(20)] for label in range(4)}
    rows = []
    for i in range(900):
        label = dice.randrange(4)
        rows.append((i, [c * 0.6 + dice.gauss(0, 0.5) + 0.4 for c in centre[label]], label))
    rows[3] = (3, None, 1)
    rows[4] = (4, [1.0] * 19 + [None], 1)
    rows[5] = (5, [float("nan")] * 20, 1)
    rows[6] = (6, [float("inf")] + [0.0] * 19, 1)
    rows[8] = (8, rows[8][1], None)
    rows[9] = (None, rows[9][1], 2)
    rows[10] = (10, [], 2)
    rows[11] = (11, rows[11][1][:7], 1)
    rows[12] = (12, [0.0] * 20, 1)
    return rows + [(1000 + i, rows[100][1], 3) for i in range(300)] + [rows[200], rows[201], rows[300]]


def test_against_all_pairs(spark, odd_rows):
    want = plain(odd_rows)
    assert len(want) > 200
    assert mined(spark.createDataFrame(odd_rows, COLUMNS).coalesce(1)) == want


def test_many_blocks_and_tasks(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(n, "BLOCK_VALUES", 80)
    monkeypatch.setattr(n, "PAIRS", 100)
    rows = [r for i, r in enumerate(odd_rows) if r[0] is not None and r[0] < 1000 and i < 900]  # ids tell all apart
    assert mined(spark.createDataFrame(rows, COLUMNS).repartition(7)) == plain(rows)


@pytest.mark.parametrize("size", [1, 7, 64, 100])
def test_intervals_hold_every_score(size):
    make = np.random.default_rng(size)
    q = np.floor(make.standard_normal((200, size)) * make.choice([1, 300], (200, 1)))
    q[:3] = 0
    q[3:6] = q[6]
    codes = n.Codes.of(q, n.rotation(size))
    lower, upper = codes.intervals(codes)
    scores = q @ q.T
    assert (lower <= scores).all() and (scores <= upper).all()
    assert (codes.beside <= np.linalg.norm(q, axis=1) + 1e-9).all()


def test_intervals_spare_most_pairs_of_strong_codes():
    """Vectors that lie along their codes are told apart without scoring."""
    make, turn = np.random.default_rng(1), n.rotation(64)
    q = np.floor(np.sign(make.standard_normal((300, 64))) @ turn.T * 2000)
    codes = n.Codes.of(q, turn)
    _, upper = codes.intervals(codes)
    assert (upper > 0.5 * (q * q).sum(axis=1)[:, None]).mean() < 0.02


def test_empty_tables_no_anchors_and_clashing_names(spark, odd_rows):
    none = spark.createDataFrame([], COLUMNS)
    assert mined(none) == []
    assert mined(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], COLUMNS)) == []
    assert mined(spark.createDataFrame([(100, [1.0], 1)], COLUMNS)) == []
    df = spark.createDataFrame(odd_rows[:300], COLUMNS).select(
        "*", *[F.lit(5).alias(c) for c in ("row", "q", "block", "rank", "score", "list", "at")])
    assert mined(df) == plain(odd_rows[:300])
    with pytest.raises(Exception, match="too long"):
        mined(spark.createDataFrame([(1, [3e30], 1)], COLUMNS))
