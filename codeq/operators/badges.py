"""Badges: who has earned which, and which are still to be handed out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeq.operators.changes import acknowledged
from codeq.operators.rollups import author_counts, complete
from codeq.operators.running import first_rows
from codeq.operators.timeline import first_review, longest_streak, review_days
from codeq.rules.catalogue import badges_frame

METRICS = ("reviews", "critical_found", "quality_score", "issues_fixed", "streak_days")


def fixed_issues(toggles: DataFrame) -> DataFrame:
    """Acknowledged issues per review."""
    return acknowledged(toggles).filter("is_acknowledged").groupBy("review_id").agg(
        F.count("*").alias("n_fixed"))


def issues_fixed(toggles: DataFrame, reviews: DataFrame) -> DataFrame:
    """Acknowledged issues per author."""
    return fixed_issues(toggles).join(reviews.select("review_id", "author_id"), "review_id").groupBy(
        "author_id").agg(F.sum("n_fixed").alias("issues_fixed"))


def author_metrics(reviews: DataFrame, issues: DataFrame, toggles: DataFrame) -> DataFrame:
    """What badges are awarded for, one row per author with a complete review."""
    base = complete(reviews).groupBy("author_id").agg(
        F.count("*").alias("reviews"), F.max("quality_score").alias("quality_score"),
        F.max("created_at").alias("last_review"))
    critical = author_counts(issues, reviews).select(
        "author_id", F.col("critical").alias("critical_found"))
    streak = longest_streak(review_days(reviews)).withColumnRenamed("user_id", "author_id")
    joined = base
    for part in (critical, issues_fixed(toggles, reviews), streak):
        joined = joined.join(part, "author_id", "left")
    return joined.fillna(0, list(METRICS))


def badge_awards(metrics: DataFrame) -> DataFrame:
    """(user_id, badge_id, earned_at) of every badge whose criterion an author meets.

    The badge side is the constant list of badges, so broadcasting it is bounded.
    """
    spark = metrics.sparkSession
    asked = badges_frame(spark).select(
        "badge_id", "slug", F.explode("criteria").alias("metric", "threshold"))
    reached = metrics.select(
        "author_id", "last_review", *[F.col(m).cast("double").alias(m) for m in METRICS]
    ).unpivot(["author_id", "last_review"], list(METRICS), "metric", "value")
    met = reached.join(F.broadcast(asked), "metric").filter(F.col("value") >= F.col("threshold"))
    return met.select(F.col("author_id").alias("user_id"), "badge_id", "slug",
                      F.col("last_review").alias("earned_at"))


def user_badges(reviews: DataFrame, issues: DataFrame, toggles: DataFrame) -> DataFrame:
    """Awards, the first-review badge dated by the first review, the others by the last."""
    awards = badge_awards(author_metrics(reviews, issues, toggles))
    first = first_review(reviews).select(
        F.col("author_id").alias("user_id"), F.col("created_at").alias("first_at"))
    return awards.join(first, "user_id").select(
        "user_id", "badge_id", "slug",
        F.when(F.col("slug") == "first-review", F.col("first_at"))
        .otherwise(F.col("earned_at")).alias("earned_at"))


def with_badge_details(held: DataFrame) -> DataFrame:
    details = badges_frame(held.sparkSession).select("badge_id", "name", "description")
    return held.join(F.broadcast(details), "badge_id")


def badge_holders(held: DataFrame) -> DataFrame:
    """Every badge with the number of users who hold it."""
    counts = held.groupBy("badge_id").agg(F.count("*").alias("n_holders"))
    return badges_frame(held.sparkSession).join(counts, "badge_id", "left").fillna(
        0, ["n_holders"])


def not_held(awards: DataFrame, held: DataFrame) -> DataFrame:
    """Awards a user does not hold yet."""
    return awards.join(held, ["user_id", "badge_id"], "left_anti")


def newest_badges(held: DataFrame, n: int = 4) -> DataFrame:
    return first_rows(held, ["user_id"], ["-earned_at", "badge_id"], n)


def first_review_awards(reviews: DataFrame, held: DataFrame) -> DataFrame:
    """The first-review badge for authors with exactly one complete review who lack it."""
    one = complete(reviews).groupBy("author_id").agg(F.count("*").alias("n")).filter("n = 1")
    awards = one.select(F.col("author_id").alias("user_id"),
                        F.lit(1).cast("long").alias("badge_id"))
    return not_held(awards, held)
