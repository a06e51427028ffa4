"""Roll-ups, timelines, lists, badges and documents on small tables, hot keys included."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from codeq.operators import (
    audits, badges, changes, findings, listing, metrics, nested, rollups, running, timeline,
)
from codeq.plans import corpus, platform
from codeq.sources import tables

START = dt.datetime(2024, 1, 1)
REVIEW = ("review_id long, author_id long, repository_id long, title string, status string, "
          "quality_score double, total_lines long, created_at timestamp_ntz")


def review_row(i, author, score=80.0, day=0, status="complete", repo=None):
    return (i, author, repo, f"Review number {i} of a long series", status, score, 10,
            START + dt.timedelta(days=day))


@pytest.fixture(scope="module")
def hot_reviews(spark):
    """Author 1 has 2600 reviews, 30 a day; 40 others have a few."""
    dice = random.Random(5)
    rows = [review_row(i, 1 if i < 2600 else 2 + i % 40, dice.randrange(201) / 2,
                       i // 30 if i < 2600 else dice.randrange(90), repo=1 if i % 2 else None)
            for i in range(3000)]
    dice.shuffle(rows)
    return rows, spark.createDataFrame(rows, REVIEW).cache()


def by_author(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[7], r[0])):
        if r[4] == "complete":
            out.setdefault(r[1], []).append(r)
    return out


def test_running_average(hot_reviews):
    rows, df = hot_reviews
    got = {r["review_id"]: (r["review_num"], r["rolling_quality"])
           for r in timeline.rolling_quality(df).collect()}
    assert len(got) == len(rows)
    for own in by_author(rows).values():
        total = 0.0
        for n, r in enumerate(own, 1):
            total += r[5]
            assert got[r[0]] == (n, pytest.approx(total / n, abs=1e-9))


def test_rolling_score_settles(hot_reviews):
    rows, df = hot_reviews
    got = {r["author_id"]: r["quality_score"] for r in timeline.rolling_quality_exact(df).collect()}
    for author, own in by_author(rows).items():
        q = 0.0
        for n, r in enumerate(own, 1):
            q = round((q * (n - 1) + r[5]) / n, 1)
        assert got[author] == q
    assert len(by_author(rows)[1]) > timeline.SETTLED_AFTER


def test_trend_and_recent(hot_reviews):
    rows, df = hot_reviews
    trend = {(r["author_id"], r["review_num"]): r for r in timeline.quality_trend(df).collect()}
    recent = {(r["author_id"], r["place"]): r["review_id"]
              for r in timeline.recent_reviews(df).collect()}
    for author, own in by_author(rows).items():
        last = own[-10:]
        for n, r in enumerate(last, 1):
            assert trend[author, n]["review_id"] == r[0]
            assert trend[author, n]["title"] == r[3][:30]
            assert trend[author, n]["date"] == r[7].strftime("%b %d")
        assert [recent[author, p] for p in range(1, min(5, len(own)) + 1)] == [
            r[0] for r in own[::-1][:5]]


def test_positions_of_reviews(hot_reviews):
    rows, df = hot_reviews
    got = {r["review_id"]: r["position"] for r in listing.order_reviews(df).collect()}
    for own in by_author(rows).values():
        assert [got[r[0]] for r in own[::-1]] == list(range(1, len(own) + 1))


def test_a_hot_author_with_distinct_times_is_split(spark):
    """Microsecond times, one author with all reviews: no task gets more than a small part of them."""
    dice = random.Random(8)
    times = sorted(START + dt.timedelta(microseconds=dice.randrange(10**6 * 86400)) for _ in range(5000))
    rows = [review_row(i, 1)[:7] + (t,) for i, t in enumerate(times)]
    dice.shuffle(rows)
    cut = running.by_time(spark.createDataFrame(rows, REVIEW), "created_at", "review_id")
    per_minute = cut.groupBy("minute").count().agg(F.count("*"), F.max("count")).first()
    per_fine = cut.groupBy("minute", "created_at", "block").count().agg(F.max("count")).first()
    assert per_minute[0] <= 1440 and per_minute[1] < 30 and per_fine[0] == 1
    got = {r["review_id"]: r["position"] for r in listing.order_reviews(spark.createDataFrame(rows, REVIEW)).collect()}
    assert [got[i] for i in range(5000)] == list(range(5000, 0, -1))


def test_running_totals_read_their_input_twice(spark, tmp_path):
    path = str(tmp_path / "reviews")
    spark.createDataFrame([review_row(i, 1, day=i) for i in range(5)], REVIEW).write.parquet(path)
    plan = listing.order_reviews(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "Union" not in plan


@pytest.mark.parametrize("first, rest", [(0.0, 100.0), (100.0, 0.0)])
def test_the_score_is_settled_after_2000(spark, first, rest):
    rows = [review_row(i, 1, first if i < 2000 else rest, day=i) for i in range(2001)]
    got = timeline.rolling_quality_exact(spark.createDataFrame(rows, REVIEW)).first()
    assert got["quality_score"] == first


@pytest.mark.parametrize("score", [400.0, -1.0, None])
def test_scores_out_of_range_are_refused(spark, score):
    df = spark.createDataFrame([review_row(1, 1, score)], REVIEW)
    with pytest.raises(Exception, match="score from 0 to 100"):
        timeline.rolling_quality_exact(df).collect()


def test_first_rows_beyond_the_group_limit(hot_reviews):
    rows, df = hot_reviews
    got = running.first_rows(df, ["author_id"], ["created_at", "review_id"], 1500)
    places = {r["review_id"]: r["place"] for r in got.collect()}
    for own in by_author(rows).values():
        assert [places.get(r[0]) for r in own] == [
            n if n <= 1500 else None for n in range(1, len(own) + 1)]


def test_page_keeps_the_whole_total(spark):
    rows = [review_row(i, 1, day=i, status="complete" if i % 2 else "failed") for i in range(10)]
    page = listing.page_of_reviews(spark.createDataFrame(rows, REVIEW), "complete", skip=1, limit=2)
    assert [(r["review_id"], r["total"]) for r in page.orderBy("place").collect()] == [(7, 10), (5, 10)]


def test_streaks(spark):
    days = [(1, d) for d in (1, 2, 2, 3, 7, 8)] + [(2, 5)] + [(3, 9), (3, 10)]
    df = spark.createDataFrame([(u, dt.date(2024, 1, d)) for u, d in days], "user_id long, day date")
    assert {r[0]: r[1] for r in timeline.longest_streak(df).collect()} == {1: 3, 2: 1, 3: 2}
    today = F.lit("2024-01-09").cast("date")
    assert {r[0]: r[1] for r in timeline.current_streak(df, today).collect()} == {1: 2, 2: 0, 3: 1}


ISSUE = ("issue_id string, review_id long, rule_id string, category string, severity string, "
         "title string, line_start int, is_fixable boolean")


@pytest.fixture(scope="module")
def hot_issues(spark):
    dice = random.Random(3)
    rows = [(f"{dice.getrandbits(64):016x}", 1 if i % 3 else 2 + i % 50, f"R{dice.randrange(7)}",
             dice.choice(["style", "security"]), dice.choice(["critical", "error", "warning", "info"]),
             "t", dice.choice([None, 1, 2, 3]), bool(dice.randrange(2))) for i in range(3000)]
    return rows, spark.createDataFrame(rows, ISSUE).cache()


def test_issue_order(hot_issues):
    rows, df = hot_issues
    rank = {"critical": 4, "error": 3, "warning": 2, "info": 1}
    got = {r["issue_id"]: r["position"] for r in listing.order_issues(df).collect()}
    by_review = {}
    for r in rows:
        by_review.setdefault(r[1], []).append(r)
    for own in by_review.values():
        own.sort(key=lambda r: (-rank[r[4]], r[6] is None, r[6] or 0, r[2], r[0]))
        assert [got[r[0]] for r in own] == list(range(1, len(own) + 1))


def test_rollups(spark, hot_issues):
    rows, issues = hot_issues
    reviews = spark.createDataFrame(
        [review_row(i, i % 5, score=None if i == 3 else 70.5, repo=i % 2 or None,
                    status="failed" if i == 7 else "complete") for i in range(60)], REVIEW)
    users = spark.createDataFrame([(u, f"u{u}", u != 4) for u in range(6)],
                                  "user_id long, username string, is_active boolean")
    by_sev = {(r["author_id"], r["severity"]): r["n"] for r in
              rollups.severities_by_author(issues, reviews, users).collect()}
    assert len(by_sev) == 24 and by_sev[5, "info"] == 0
    assert sum(by_sev.values()) == len(rows)
    share = rollups.categories_by_author(issues, reviews).groupBy("author_id").agg(
        F.sum("pct").alias("s")).collect()
    assert all(r["s"] == pytest.approx(100) for r in share)
    stats = {r["author_id"]: r for r in rollups.author_stats(issues, reviews, users).collect()}
    assert stats[5]["avg_quality"] == 0.0 and stats[3]["avg_quality"] == round(11 * 70.5 / 12, 1)
    assert sum(s["fixable_issues"] for s in stats.values()) == sum(r[7] for r in rows)
    total = rollups.global_stats(issues, reviews, users).first()
    assert tuple(total) == (5, 59, 3000)
    repo = rollups.repository_rollup(issues, reviews).collect()
    assert [r["repository_id"] for r in repo] == [1]
    assert sum(repo[0]["issues_by_severity"].values()) == repo[0]["total_issues"]
    assert rollups.top_rules(issues, reviews).groupBy("author_id").count().agg(F.max("count")).first()[0] == 5
    named = rollups.with_repository(reviews, reviews.filter("repository_id is not null").select(
        "repository_id", F.lit("n").alias("name"), F.lit(1).alias("updated_at")).distinct())
    assert named.count() == 60 and named.filter("name is not null").count() == 30


def test_badges(spark):
    toggles = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1)], "review_id long, issue_no long")
    state = {(r[0], r[1]): r[2] for r in changes.acknowledged(toggles).collect()}
    assert state == {(1, 1): False, (1, 2): True, (2, 1): True}
    reviews = spark.createDataFrame(
        [review_row(i, 1, 95.0 if i == 3 else 50.0, day=i) for i in range(10)]
        + [review_row(100, 2, 89.5)], REVIEW)
    issues = spark.createDataFrame(
        [(str(i), 1, "R", "security", "critical", "t", 1, False) for i in range(5)], ISSUE)
    held = badges.user_badges(reviews, issues, toggles)
    got = {(r["user_id"], r["slug"]) for r in held.collect()}
    assert got == {(1, "first-review"), (1, "code-guardian"), (1, "security-hawk"),
                   (1, "clean-coder"), (1, "streak-3"), (2, "first-review")}
    assert badges.not_held(held, held).count() == 0
    assert badges.newest_badges(held).filter("user_id = 1").count() == 4
    nobody = held.filter("false").select("user_id", "badge_id")
    assert [r["user_id"] for r in badges.first_review_awards(reviews, nobody).collect()] == [2]


def test_status_suggestions_and_audits(spark):
    events = spark.createDataFrame(
        [(1, "pending", 1), (1, "analyzing", 2), (1, "complete", 9), (2, "pending", 3)],
        "review_id long, status string, d int").withColumn("day", F.expr("date_add('2024-01-01', d)"))
    at = lambda d: {r[0]: r[1] for r in changes.latest_status(
        events, F.lit(f"2024-01-{d:02}").cast("date")).collect()}
    assert at(3) == {1: "analyzing"} and at(20) == {1: "complete", 2: "pending"}
    users = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", None)],
                                  "user_id long, username string, email string")
    taken = listing.taken_accounts(users).collect()
    assert {r["user_id"] for r in taken} == {1, 2} and not any(r["username_taken"] for r in taken)
    children = spark.createDataFrame([(1,), (1,), (9,), (None,)], "ref long")
    row = audits.audit_references({"e": (children, "ref", users, "user_id")}).first()
    assert (row["n_rows"], row["n_orphans"]) == (3, 1)
    nulls = audits.audit_texts({"users": (users, {"email": 5, "username": 0})}).collect()
    assert {tuple(r) for r in nulls} == {("users.email", 1, 0), ("users.username", 0, 3)}


def test_leaderboard_ties(spark):
    users = spark.createDataFrame([(u, f"u{u}", f"Name {u}", u != 3) for u in range(15)],
                                  "user_id long, username string, full_name string, is_active boolean")
    rows = [review_row(u, u, 90.0 if u < 6 else 50.0) for u in range(14)] + [review_row(99, 0, 90.0, day=1)]
    reviews = spark.createDataFrame(rows, REVIEW)
    issues = spark.createDataFrame([(0,), (99,), (99,), (3,)], "review_id long")
    board = listing.leaderboard(users, reviews, issues).orderBy("rank").collect()
    assert [r["user_id"] for r in board] == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10]
    assert [(r["total_reviews"], r["total_issues_found"], r["streak_days"]) for r in board[:2]] == [
        (2, 3, 2), (1, 0, 1)]
    assert board[0]["full_name"] == "Name 0"


@pytest.mark.parametrize("n", [19, 20, 21, 90])
def test_review_documents_have_one_grain(make_files, n):
    """One row per file, however many files a review has."""
    files = make_files({i: (f"f{i}.py", f"eval(x{i})\nprint({i})\n" if i else "", "hot") for i in range(n)})
    found, measured = findings.all_findings(files), metrics.file_metrics(files)
    rows = nested.review_detail(files, measured, found).orderBy("file_id").collect()
    assert [(r["review_id"], r["file_id"]) for r in rows] == [("hot", i) for i in range(n)]
    assert rows[0]["issues"] == [] and rows[0]["annotations"] == {}
    assert all(r["annotations"]["1"] == ["[CRITICAL] Dangerous eval() usage"] for r in rows[1:])
    assert all(r["issues"][0]["suggestions"][0]["confidence"] == 0.9 for r in rows[1:])


def test_review_documents_read_the_text_once(spark, tmp_path):
    """What is joined comes from written tables; rows are as from metrics and findings apart, also where ids repeat."""
    texts = ["eval(x)\nprint(1)\n", None, "", "SELECT * FROM t\n" * 3, "x" * 200, "TODO: eval (\n\n# FIXME"]
    rows = [(i % 60 if i else None, texts[i % len(texts)], f"r{i % 3}") for i in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    built = platform._detail(spark, str(tmp_path))
    plan = built._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "facts" not in plan
    files = tables.files(spark, str(tmp_path))
    apart = nested.review_detail(files, metrics.file_metrics(files), corpus.comparable(findings.all_findings(files)))
    wanted, found = (sorted(map(repr, x.select(built.columns).collect())) for x in (apart, built))
    assert found == wanted and len(found) == 31 + 29 * 4

