"""Streams run in several batches end where the batch job ends."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from codeq.operators import duplication, scan, timeline
from codeq.sources.snippets import SNIPPETS
from codeq.streaming import jobs
from tests.test_platform import REVIEW, START, by_author, review_row


def updated(*keys):
    return lambda stream, folder: jobs.update(stream, folder, *keys)


def in_steps(spark, tmp_path, frames, schema, job, run):
    """Feed frames to a job one run at a time, over one checkpoint."""
    source, folder = str(tmp_path / "in"), str(tmp_path / "job")
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(source)
        out = run(job(spark.readStream.schema(schema).parquet(source)), folder)
    return out


def test_findings(spark, tmp_path, make_files):
    texts = [(f"f.{ext}", code) for ext, code in SNIPPETS]
    whole = make_files(dict(enumerate(texts)))
    steps = [whole.filter(F.col("file_id") % 3 == k) for k in range(3)]
    out = in_steps(spark, tmp_path, steps, whole.schema, jobs.findings, jobs.append)
    assert sorted(spark.read.parquet(out).collect()) == sorted(scan.scan_rules(whole).collect())


def reviews_in_steps(spark):
    dice = random.Random(9)
    rows = [review_row(i, 1 if i < 2300 else i % 7, dice.randrange(201) / 2, i // 100,
                       "complete" if i % 10 else "failed") for i in range(2700)]
    whole = spark.createDataFrame(rows, REVIEW)
    return rows, whole, [whole.filter(F.col("created_at") < START + dt.timedelta(days=8)),
                         whole.filter((F.col("created_at") >= START + dt.timedelta(days=8))
                                      & (F.col("created_at") < START + dt.timedelta(days=20))),
                         whole.filter(F.col("created_at") >= START + dt.timedelta(days=20))]


def test_author_totals_and_badges(spark, tmp_path):
    rows, whole, steps = reviews_in_steps(spark)
    out = in_steps(spark, tmp_path / "t", steps, whole.schema, jobs.author_totals, updated("author_id"))
    got = {r["author_id"]: r["total_reviews"] for r in jobs.latest(spark, out, "author_id").collect()}
    assert got == {a: len(own) for a, own in by_author(rows).items()}
    out = in_steps(spark, tmp_path / "b", steps, whole.schema, jobs.first_badges,
                   updated("user_id", "badge_id"))
    awards = jobs.latest(spark, out, "user_id", "badge_id").collect()
    assert {r["user_id"]: r["earned_at"] for r in awards} == {
        a: own[0][7] for a, own in by_author(rows).items()}


@pytest.mark.parametrize("cut", ["by time", "late", "mixed"])
def test_rolling_quality(spark, tmp_path, cut):
    """Reviews in any order, in any cut into batches, also when an author's first ones come last."""
    rows, whole, steps = reviews_in_steps(spark)
    if cut == "late":
        steps = steps[::-1]
    if cut == "mixed":
        steps = [whole.filter(F.pmod(F.hash("review_id"), F.lit(3)) == k) for k in range(3)]
    out = in_steps(spark, tmp_path, steps, whole.schema, lambda reviews: reviews, jobs.rolling_quality)
    got = {r["author_id"]: (r["quality_score"], r["n_reviews"]) for r in jobs.rolling_scores(spark, out).collect()}
    want = {r["author_id"]: r["quality_score"] for r in timeline.rolling_quality_exact(whole).collect()}
    own = by_author(rows)
    assert got == {a: (q, len(own[a])) for a, q in want.items()} and len(own[1]) > timeline.SETTLED_AFTER


def test_first_reviews_sorts_few_rows_of_a_hot_author(spark):
    rows = [review_row(i, 1 if i % 10 else 2 + i % 3, 50.0, i // 40, "complete") for i in range(6000)]
    scored = spark.createDataFrame(rows, REVIEW).select("author_id", "review_id", "created_at", "quality_score")
    for n in (1, 7, 2000):
        got = {(r["author_id"], r["review_id"]) for r in timeline.first_reviews(scored, n).collect()}
        assert got == {(a, r[0]) for a, own in by_author(rows).items()
                       for r in sorted(own, key=lambda r: (r[7], r[0]))[:n]}


def test_late_events_are_left_out(spark, tmp_path):
    schema = "event_id long, user_id long, ts timestamp_ntz, event_type string, value double"
    row = lambda i, minute: (i, 1, START + dt.timedelta(minutes=minute), "view", 1.0)
    steps = [spark.createDataFrame(rows, schema) for rows in (
        [row(1, 5), row(2, 65)], [row(3, 300)], [row(4, 6), row(5, 301)])]
    out = in_steps(spark, tmp_path, steps, steps[0].schema, jobs.window_counts,
                   updated("window_start", "event_type"))
    counts = jobs.latest(spark, out, "window_start", "event_type").orderBy("window_start").collect()
    assert [r["n"] for r in counts] == [1, 1, 2]


ACTIVITY = "event_id long, user_id long, ts timestamp_ntz, event_type string, value double"


def event(i, minute, user=1, kind="view"):
    return (i, user, None if minute is None else START + dt.timedelta(minutes=minute), kind, 1.0)


def session_rows(spark, out):
    return sorted((r["user_id"], (r["started_at"] - START).total_seconds() / 60,
                   (r["ended_at"] - START).total_seconds() / 60, r["n_events"]) for r in spark.read.parquet(out).collect())


def test_sessions_merge_with_late_rows(spark, tmp_path):
    steps = [spark.createDataFrame(rows, ACTIVITY) for rows in (
        [event(1, 0), event(2, 50), event(3, 0, 2), event(4, 30, 2), event(5, 61, 2)],
        [event(6, 25), event(7, None), event(8, 200)],  # the first joins what lies 25 minutes to either side
        [event(9, 1000)],
        [event(10, 100), event(11, 990)],  # the first is later than the watermark
    )]
    steps.append(jobs.heartbeat(steps[-1].union(steps[2]), "2 days"))
    out = in_steps(spark, tmp_path, steps, steps[0].schema, lambda a: jobs.sessions(a, late="5 hours"), jobs.append_sessions)
    got = session_rows(spark, out)
    by_user = [x for x in got if x[0] == 1]
    assert by_user == [(1, 0.0, 50.0, 3), (1, 200.0, 200.0, 1), (1, 990.0, 1000.0, 2)]
    # Exactly the gap still joins, a minute more does not.
    assert [x for x in got if x[0] == 2] == [(2, 0.0, 30.0, 2), (2, 61.0, 61.0, 1)]
    assert spark.conf.get(jobs.MERGE_SESSIONS, None) in (None, "false")


def test_sessions_in_any_cut(spark, tmp_path):
    dice = random.Random(4)
    rows = [event(i, dice.randrange(4000), dice.choice([1, 1, 1, 2, 3, None])) for i in range(400)]
    whole = spark.createDataFrame(rows, ACTIVITY)
    steps = [whole.filter(F.pmod(F.hash("event_id"), F.lit(4)) == k) for k in range(4)] + [jobs.heartbeat(whole, "9 days")]
    out = in_steps(spark, tmp_path, steps, whole.schema, lambda a: jobs.sessions(a, late="4 days"), jobs.append_sessions)
    want = []
    for user in (1, 2, 3, None):
        own = sorted((r[2] - START).total_seconds() / 60 for r in rows if r[1] == user)
        start = 0
        for i in range(1, len(own) + 1):
            if i == len(own) or own[i] - own[i - 1] > 30:
                want.append((user, own[start], own[i - 1], i - start))
                start = i
    assert sorted(map(str, ((r["user_id"], (r["started_at"] - START).total_seconds() / 60,
                             (r["ended_at"] - START).total_seconds() / 60, r["n_events"])
                            for r in spark.read.parquet(out).collect()))) == sorted(map(str, want))


def test_every_row_is_counted_waits_or_is_too_late(spark, tmp_path):
    steps = [spark.createDataFrame(rows, ACTIVITY) for rows in (
        [event(1, 5), event(2, 65), event(3, None)],
        [event(4, 300), event(5, 50)],  # the window of 5 ended at 60, the watermark is 55
        [event(6, 239), event(7, 241), event(8, 6, kind="click"), event(9, 301)],
    )]
    folder = str(tmp_path / "job")
    for step in steps:
        step.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        counts, rows = jobs.windows_and_late(
            spark.readStream.schema(steps[0].schema).parquet(str(tmp_path / "in")), folder)
    assert {r["event_id"] for r in jobs.late_rows(spark, rows).collect()} == {3, 6, 8}
    got = {((r["window_start"] - START).total_seconds() / 3600, r["event_type"], r["n"])
           for r in spark.read.parquet(counts).collect()}
    assert got == {(0.0, "view", 2), (1.0, "view", 1)}
    assert {r["event_id"] for r in spark.read.parquet(rows).filter("too_late = 'false'").collect()} == {1, 2, 4, 5, 7, 9}


def test_merged_parts_stay_few_and_lose_nothing(spark, tmp_path, monkeypatch):
    import glob

    from codeq.streaming import merged
    folder = str(tmp_path / "parts")
    parts = merged.MergedParts(spark, folder, merged.sums("k"))
    one = lambda b: spark.createDataFrame([(b % 3, 1), (7, b)], "k long, n long").coalesce(1)
    assert parts.read() is None
    for b in range(40):
        if b == 20:  # a crash between the parts and the manifest
            monkeypatch.setattr(spark, "createDataFrame", None)
            with pytest.raises(TypeError):
                parts.add(spark.sql("select 2L k, 1L n union all select 7L, 20L"), b)
            monkeypatch.undo()
        parts.add(one(b), b)
        if b in (5, 20):
            parts.add(one(b), b)  # a batch that comes again
        assert len(parts.paths()) <= 2 * (merged.FAN - 1)
    assert {r["k"]: r["n"] for r in parts.read().collect()} == {0: 14, 1: 13, 2: 13, 7: sum(range(40))}
    assert len(glob.glob(f"{folder}/manifest/*.parquet")) <= merged.FAN + merged.KEPT_MANIFESTS + 1
    assert len(glob.glob(f"{folder}/parts/*")) < 30


@pytest.mark.parametrize("seed", range(2))
def test_streaks_of_days_in_any_order(spark, tmp_path, seed):
    dice = random.Random(seed)
    rows = [(dice.choice([1, 2, 3, None]), START.date() + dt.timedelta(days=dice.randrange(60))) for _ in range(150)]
    rows += [(4, None), (5, START.date()), (5, START.date())]
    whole = spark.createDataFrame(rows, "user_id long, day date")
    dice.shuffle(rows)
    seen, source, folder = [], str(tmp_path / "in"), str(tmp_path / "job")
    for k in range(10):  # more than a level of parts
        seen += rows[k::10]
        spark.createDataFrame(rows[k::10], whole.schema).coalesce(1).write.mode("append").parquet(source)
        jobs.streaks(spark.readStream.schema(whole.schema).parquet(source), folder)
        if k in (0, 4, 9):
            expected = timeline.longest_streak(
                spark.createDataFrame(seen, whole.schema).filter("day is not null"))
            key = lambda r: (r[0] is not None, r[0] or 0)
            assert sorted(map(tuple, jobs.longest_streaks(spark, folder).collect()), key=key) == sorted(
                map(tuple, expected.select("user_id", "streak_days").collect()), key=key)


def test_duplication_as_files_come_and_go(spark, tmp_path, make_files):
    dice = random.Random(4)
    pool = [f"a line of code, number {i}" for i in range(9)] + ["short", "# a long enough comment"]
    files = {i: ("a.js", "\n".join(dice.choices(pool, k=dice.randrange(12))), f"r{i % 4}") for i in range(40)}
    files[40] = ("a.js", None, "r0")
    steps, here = [], {}
    for _ in range(6):
        come = {i: f for i, f in files.items() if i not in here and dice.random() < 0.5}
        go = {i: f for i, f in here.items() if dice.random() < 0.3}
        steps.append(make_files(come).withColumn("sign", F.lit(1)).union(make_files(go).withColumn("sign", F.lit(-1))))
        here = {i: f for i, f in {**here, **come}.items() if i not in go}
    out = in_steps(spark, tmp_path, steps, steps[0].schema, lambda stream: stream, jobs.duplication)
    left = duplication.duplication(make_files(here)).filter("n_lines > 0")
    assert here and sorted(jobs.duplication_now(spark, out).collect()) == sorted(left.collect())
