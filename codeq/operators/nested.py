"""Nested documents. Every list in them is bounded by what it lists, never by the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeq.functions.rounding import round_exact
from codeq.operators.badges import fixed_issues
from codeq.operators.changes import FIX_CONFIDENCE
from codeq.operators.findings import annotations
from codeq.operators.rollups import SUMMED, review_counts
from codeq.operators.syntax import FINDING_FIELDS
from codeq.operators.timeline import quality_trend, recent_reviews, rolling_quality_exact
from codeq.rules.catalogue import BADGES, CATEGORIES, SEVERITIES


def _listed(df: DataFrame, key: str, name: str, order: str, *columns: str) -> DataFrame:
    """One array of structs per key, in the order of a column."""
    entry = F.struct(F.col(order).alias("_order"), F.struct(*columns).alias("entry"))
    ordered = F.array_sort(F.collect_list(entry))
    return df.groupBy(key).agg(F.transform(ordered, lambda x: x.entry).alias(name))


def _or_empty(*names: str) -> dict[str, Column]:
    return {n: F.coalesce(F.col(n), F.array()) for n in names}


def _issue() -> Column:
    suggestion = F.struct(
        F.concat(F.lit("Auto-fix: "), F.col("title")).alias("title"),
        F.col("fix_description").alias("explanation"), F.lit(FIX_CONFIDENCE).alias("confidence"))
    return F.struct(
        F.col("line_start").alias("line_start"), *[c for c in FINDING_FIELDS if c != "line_start"],
        F.when(F.col("fix_description").isNotNull(), F.array(suggestion)).otherwise(F.array())
        .alias("suggestions"))


def review_detail(files: DataFrame, metrics: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per file of a review: text, metrics, issues with their suggestions, annotations.

    A review is as many rows as it has files, whatever their number; its own figures are those of
    ``review_metrics``. The lists are bounded by the file's text. ``findings`` is best given as a
    written table, as it is used twice.
    """
    issues = findings.groupBy("file_id").agg(F.sort_array(F.collect_list(_issue())).alias("issues"))
    none = F.create_map().cast("map<string,array<string>>")
    return (
        metrics.join(files.select("file_id", "content"), "file_id")
        .join(issues, "file_id", "left").join(annotations(findings), "file_id", "left")
        .withColumns({**_or_empty("issues"), "annotations": F.coalesce("annotations", none)})
    )


def earned_badges() -> Column:
    """The badges whose criterion a row of ``author_table`` meets, with the time they were earned.

    The badges are a constant list, so no join is needed.
    """
    each = []
    for b in BADGES:
        at = F.col("first_at") if b["slug"] == "first-review" else F.col("last_at")
        each.append(F.when(F.col(b["metric"]) >= b["threshold"], F.struct(
            *[F.lit(b[c]).alias(c) for c in ("slug", "name", "description")],
            F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("earned_at"))))
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def _longest_run(days: Column) -> Column:
    """Length of the longest run of consecutive days in a set of days; at most 366 days a year."""
    start = F.struct(F.lit(None).cast("date").alias("last"), F.lit(0).cast("long").alias("run"),
                     F.lit(0).cast("long").alias("best"))

    def step(acc: Column, day: Column) -> Column:
        run = F.when(F.date_add(acc["last"], 1) == day, acc["run"] + 1).otherwise(1).cast("long")
        return F.struct(day.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))
    return F.aggregate(F.array_sort(days), start, step, lambda acc: acc["best"])


def author_table(reviews: DataFrame, toggles: DataFrame) -> DataFrame:
    """One row per author: figures of the reviews, the rolling score, and what badges ask for of them."""
    fixed = fixed_issues(toggles)
    done = F.col("status") == "complete"
    of_done = {c: F.when(done, F.col(c)) for c in ("quality_score", "total_lines", "created_at")}
    figures = reviews.join(fixed, "review_id", "left").groupBy("author_id").agg(
        F.count_if(done).alias("reviews"),
        F.sum(F.coalesce(of_done["quality_score"], F.lit(0.0)).cast(SUMMED)).alias("score_sum"),
        F.coalesce(F.sum(of_done["total_lines"]), F.lit(0)).alias("total_lines_reviewed"),
        F.max(of_done["quality_score"]).alias("best_score"),
        F.min(of_done["created_at"]).alias("first_at"), F.max(of_done["created_at"]).alias("last_at"),
        F.coalesce(F.sum("n_fixed"), F.lit(0)).alias("issues_fixed"),
        F.collect_set(F.to_date(of_done["created_at"])).alias("days"))
    scores = rolling_quality_exact(reviews).withColumnRenamed("quality_score", "rolling_score")
    return figures.join(scores, "author_id", "left").withColumn(
        "streak_days", _longest_run(F.col("days"))).drop("days")


def _with_badges(joined: DataFrame) -> DataFrame:
    """Rows with ``badges``; the score that a badge asks for is the best of one review."""
    asked = joined.withColumn("quality_score", F.col("best_score"))
    return asked.withColumn("badges", F.when(F.col("reviews") > 0, earned_badges()).otherwise(F.array()))


SEVERITY_COUNTS = {"total_issues": "n_issues", **{f"{s}_issues": s for s in SEVERITIES}}


def user_profile(users: DataFrame, reviews: DataFrame, issues: DataFrame,
                 toggles: DataFrame) -> DataFrame:
    """Users with their score, counters, badges and newest complete reviews."""
    per_review = review_counts(issues).select("review_id", "n_issues", *SEVERITIES)
    found = per_review.join(reviews.select("review_id", "author_id", "status"), "review_id").groupBy(
        "author_id").agg(
        F.sum("critical").alias("critical_found"),
        F.sum(F.when(F.col("status") == "complete", F.col("n_issues"))).alias("total_issues_found"))
    recent = recent_reviews(reviews).select(
        "author_id", "review_id", "title", "status", "quality_score", "created_at", "place")
    listed = recent.join(per_review, "review_id", "left").fillna(0, ["n_issues", *SEVERITIES]).withColumn(
        "created_at", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"))
    recents = _listed(listed, "author_id", "recent_reviews", "place", "review_id", "title", "status",
                      "quality_score", *[F.col(c).alias(n) for n, c in SEVERITY_COUNTS.items()], "created_at")
    joined = users.select(F.col("user_id").alias("author_id"), "username", "full_name")
    for part in (author_table(reviews, toggles), found, recents):
        joined = joined.join(part, "author_id", "left")
    numbers = ["reviews", "rolling_score", "streak_days", "issues_fixed", "critical_found", "total_issues_found"]
    return _with_badges(joined.fillna(0, numbers)).select(
        F.col("author_id").alias("user_id"), "username", "full_name", F.col("rolling_score").alias("quality_score"),
        F.col("reviews").alias("total_reviews"), "total_issues_found", "streak_days", "issues_fixed", "badges",
        _or_empty("recent_reviews")["recent_reviews"].alias("recent_reviews"))


def _sum_of(field: str, value: str) -> Column:
    """Issues of the entries of ``rules`` that have this value."""
    return _sum_where(lambda r: r[field] == value)


def _sum_where(condition) -> Column:
    return F.aggregate(F.filter("rules", condition), F.lit(0).cast("long"), lambda acc, r: acc + r["n"])


def _top_rules(k: int = 5) -> Column:
    """The most frequent rules of ``rules``, ties by rule id; a rule may have several texts."""
    def one(rule_id: Column) -> Column:
        own = F.filter("rules", lambda r: r["rule_id"] == rule_id)
        n = F.aggregate(own, F.lit(0).cast("long"), lambda acc, r: acc + r["n"])
        least = lambda c: F.array_min(F.transform(own, lambda r: r[c]))
        return F.struct((-n).alias("order"), rule_id.alias("rule_id"), least("title").alias("title"),
                        n.alias("count"), least("severity").alias("severity"))
    ids = F.array_distinct(F.transform("rules", lambda r: r["rule_id"]))
    top = F.slice(F.array_sort(F.transform(ids, one)), 1, k)
    return F.transform(top, lambda x: F.struct(*[x[c].alias(c) for c in ("rule_id", "title", "count", "severity")]))


def dashboard(users: DataFrame, reviews: DataFrame, issues: DataFrame,
              toggles: DataFrame) -> DataFrame:
    """The dashboard of every user: head, trend, distribution, top rules, badges and totals.

    Issues are read once, into one entry per author and kind of issue: at most as many as there are
    texts of rules. Distribution, totals and top rules are taken from that list.
    """
    kind = ["rule_id", "title", "severity", "category", "is_fixable"]
    per_review = issues.groupBy("review_id", *kind).agg(F.count("*").alias("n"))
    per_author = per_review.join(reviews.select("review_id", "author_id", "status"), "review_id").groupBy(
        "author_id", *kind).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("status") == "complete", F.col("n"))).alias("n_done"))
    found = per_author.groupBy("author_id").agg(
        F.collect_list(F.struct(*kind, "n")).alias("rules"), F.sum("n_done").alias("total_issues_found"))
    trend = _listed(quality_trend(reviews), "author_id", "quality_trend", "review_num",
                    "review_num", "title", "score", "date")
    joined = users.select(F.col("user_id").alias("author_id"), "username", "full_name")
    for part in (author_table(reviews, toggles), found, trend):
        joined = joined.join(part, "author_id", "left")
    numbers = ["reviews", "rolling_score", "streak_days", "issues_fixed", "total_issues_found",
               "total_lines_reviewed"]
    filled = joined.fillna(0, numbers).withColumns(_or_empty("rules", "quality_trend")).withColumns({
        "critical_found": _sum_of("severity", "critical"),
        "mean": F.coalesce(F.col("score_sum").cast("double"), F.lit(0.0)) / F.greatest("reviews", F.lit(1))})

    def entries(names: tuple[str, ...], label: str) -> Column:
        return F.array(*[F.struct(F.lit(n).alias(label), _sum_of(label, n).alias("count"))
                         for n in names])

    return _with_badges(filled).select(
        F.col("author_id").alias("user_id"),
        F.struct("username", "full_name", F.col("rolling_score").alias("quality_score"),
                 F.col("reviews").alias("total_reviews"), "streak_days", "total_issues_found").alias("user"),
        "quality_trend",
        F.filter(entries(CATEGORIES, "category"), lambda x: x["count"] > 0).alias("issues_by_category"),
        entries(SEVERITIES, "severity").alias("issues_by_severity"),
        _top_rules().alias("top_rules"), "badges",
        F.struct(round_exact(F.col("mean"), 1).alias("avg_quality"), "total_lines_reviewed",
                 _sum_where(lambda r: r["is_fixable"]).alias("fixable_issues"),
                 F.col("reviews").alias("total_reviews")).alias("stats"))


def as_json(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with nested columns as JSON text, nulls included."""
    options = {"ignoreNullFields": "false"}
    return df.withColumns({n: F.to_json(F.col(n), options) for n in names})
