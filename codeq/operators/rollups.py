"""Issues and reviews rolled up to reviews, authors, repositories and the platform.

Issues are always counted per review before they meet the reviews, so a review or author with a
huge number of issues brings one row, not all of them, to the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeq.functions.rounding import round_exact
from codeq.operators.changes import FIX_CONFIDENCE
from codeq.operators.running import first_rows
from codeq.rules.catalogue import CATEGORIES, SEVERITIES

# Doubles are summed in this type: exactly, so in any order, and to ten places.
SUMMED = "decimal(38, 10)"
COUNTS = ["n_issues", "n_fixable", *SEVERITIES, *CATEGORIES]


def complete(reviews: DataFrame) -> DataFrame:
    return reviews.filter(F.col("status") == "complete")


def review_counts(issues: DataFrame) -> DataFrame:
    """Issues per review: all, fixable, per severity and per category, in columns."""
    return issues.groupBy("review_id").agg(
        F.expr("count(*) as n_issues"), F.expr("count_if(is_fixable) as n_fixable"),
        *[F.expr(f"count_if(severity = '{s}') as {s}") for s in SEVERITIES],
        *[F.expr(f"count_if(category = '{c}') as {c}") for c in CATEGORIES])


def author_counts(issues: DataFrame, reviews: DataFrame) -> DataFrame:
    """The same per author, over all of the author's reviews."""
    joined = review_counts(issues).join(reviews.select("review_id", "author_id"), "review_id")
    return joined.groupBy("author_id").agg(*[F.expr(f"sum({c}) as {c}") for c in COUNTS])


def _long(counts: DataFrame, keys: list[str], names: tuple[str, ...], label: str) -> DataFrame:
    return counts.unpivot(keys, list(names), label, "n")


def severities_by_review(issues: DataFrame, reviews: DataFrame) -> DataFrame:
    """Four rows per review, zero where it has no issue of the severity."""
    counts = reviews.select("review_id").join(review_counts(issues), "review_id", "left")
    return _long(counts.fillna(0, list(SEVERITIES)), ["review_id"], SEVERITIES, "severity")


def severities_by_author(issues: DataFrame, reviews: DataFrame, users: DataFrame) -> DataFrame:
    """Four rows per user, zero where there is no issue of the severity."""
    counts = users.select(F.col("user_id").alias("author_id")).join(
        author_counts(issues, reviews), "author_id", "left")
    return _long(counts.fillna(0, list(SEVERITIES)), ["author_id"], SEVERITIES, "severity")


def categories_by_author(issues: DataFrame, reviews: DataFrame) -> DataFrame:
    """Categories an author has issues of, with their share of the author's issues."""
    counts = _long(author_counts(issues, reviews), ["author_id", "n_issues"], CATEGORIES,
                   "category")
    return counts.filter(F.col("n") > 0).select(
        "author_id", "category", "n", (F.col("n") / F.col("n_issues") * 100).alias("pct"))


def top_rules(issues: DataFrame, reviews: DataFrame, k: int = 5) -> DataFrame:
    """The rules each author breaks most, ties by rule id."""
    per_review = issues.groupBy("review_id", "rule_id", "title", "severity").agg(
        F.count("*").alias("n"))
    # Texts are grouped by first and only then reduced to the smallest, as hash aggregation can
    # count but not take the minimum of a text.
    per_text = (
        per_review.join(reviews.select("review_id", "author_id"), "review_id")
        .groupBy("author_id", "rule_id", "title", "severity").agg(F.sum("n").alias("n")))
    per_author = per_text.groupBy("author_id", "rule_id").agg(
        F.sum("n").alias("n"), F.min("title").alias("title"),
        F.min("severity").alias("severity"))
    return first_rows(per_author, ["author_id"], ["-n", "rule_id"], k)


def _mean_score(total: Column, n: Column) -> Column:
    return F.coalesce(total.cast("double"), F.lit(0.0)) / F.greatest(n, F.lit(1))


def _score_sums(reviews: DataFrame, *keys: str) -> DataFrame:
    """Complete reviews per key; scores are summed exactly, so order does not matter."""
    score = F.coalesce("quality_score", F.lit(0.0)).cast(SUMMED)
    return complete(reviews).groupBy(*keys).agg(
        F.count("*").alias("total_reviews"), F.sum(score).alias("score_sum"),
        F.sum(F.coalesce("total_lines", F.lit(0))).alias("total_lines"),
        F.max("quality_score").alias("best_score"))


def author_stats(issues: DataFrame, reviews: DataFrame, users: DataFrame) -> DataFrame:
    """Per user: average score, lines and number of complete reviews; fixable issues of all."""
    return with_author_stats(users.select(F.col("user_id").alias("author_id")),
                             author_counts(issues, reviews).select("author_id", "n_fixable"),
                             reviews).select("author_id", *STATS)


STATS = ("avg_quality", "total_lines_reviewed", "fixable_issues", "total_reviews")


def with_author_stats(authors: DataFrame, counts: DataFrame, reviews: DataFrame) -> DataFrame:
    """Authors with their issue counts and the statistics shown with them."""
    joined = (
        authors.join(_score_sums(reviews, "author_id"), "author_id", "left")
        .join(counts, "author_id", "left")
        .fillna(0, ["total_reviews", "total_lines", "n_fixable"])
        .withColumn("mean", _mean_score(F.col("score_sum"), F.col("total_reviews")))
    )
    return joined.withColumns({
        "avg_quality": round_exact(F.col("mean"), 1), "total_lines_reviewed": F.col("total_lines"),
        "fixable_issues": F.col("n_fixable")})


def author_totals(issues: DataFrame, reviews: DataFrame) -> DataFrame:
    """Complete reviews per author and the issues found in them."""
    found = issues.groupBy("review_id").agg(F.count("*").alias("n"))
    return (complete(reviews).select("review_id", "author_id").join(found, "review_id", "left")
            .groupBy("author_id").agg(
                F.count("*").alias("total_reviews"),
                F.sum(F.coalesce("n", F.lit(0))).alias("total_issues_found")))


def with_repository(reviews: DataFrame, repositories: DataFrame) -> DataFrame:
    """Reviews with their repository, if they have one.

    Reviews without one get a key that no repository has, a different one each, lest all of them
    end up in the task that owns the null key.
    """
    key = F.coalesce(F.col("repository_id"), -1 - F.col("review_id"))
    named = repositories.select(F.col("repository_id").alias("_key"), "name", "updated_at")
    return reviews.withColumn("_key", key).join(named, "_key", "left").drop("_key")


def repository_rollup(issues: DataFrame, reviews: DataFrame) -> DataFrame:
    """Complete reviews of a repository: number, average score, issues, and issues as maps."""
    of_repo = complete(reviews).filter(F.col("repository_id").isNotNull())
    sums = _score_sums(of_repo, "repository_id")
    counts = (of_repo.select("review_id", "repository_id").join(review_counts(issues), "review_id")
              .groupBy("repository_id").agg(*[F.expr(f"sum({c}) as {c}") for c in COUNTS]))
    joined = sums.join(counts, "repository_id", "left").fillna(0, COUNTS).withColumn(
        "mean", _mean_score(F.col("score_sum"), F.col("total_reviews")))
    return joined.select(
        "repository_id", "total_reviews", round_exact(F.col("mean"), 1).alias("avg_quality_score"),
        F.col("n_issues").alias("total_issues"),
        _count_map(SEVERITIES, zeros=True).alias("issues_by_severity"),
        _count_map(CATEGORIES, zeros=False).alias("issues_by_category"))


def _count_map(names: tuple[str, ...], zeros: bool) -> Column:
    counts = F.create_map(*[x for name in names for x in (F.lit(name), F.col(name))])
    return counts if zeros else F.map_filter(counts, lambda _, n: n > 0)


def global_stats(issues: DataFrame, reviews: DataFrame, users: DataFrame) -> DataFrame:
    """Active users, complete reviews and issues of the whole platform, in one row."""
    parts = {"total_users": users.filter("is_active"), "total_reviews": complete(reviews),
             "total_issues_found": issues}
    rows = None
    for name, part in parts.items():
        row = part.agg(*[(F.count("*") if c == name else F.lit(0).cast("long")).alias(c)
                         for c in parts])
        rows = row if rows is None else rows.unionByName(row)
    return rows.agg(*[F.sum(c).alias(c) for c in parts])


def fix_coverage(issues: DataFrame) -> DataFrame:
    """Share of issues per category that come with a fix, and how sure the fixes are on average."""
    sure = F.lit(FIX_CONFIDENCE).cast(SUMMED)
    counts = issues.groupBy("category").agg(
        F.count("*").alias("n"), F.count_if("is_fixable").alias("n_fixable"),
        F.sum(F.when(F.col("is_fixable"), sure)).cast("double").alias("sure"))
    return counts.withColumn("coverage", F.col("n_fixable") / F.col("n")).withColumn(
        "avg_confidence", F.try_divide("sure", "n_fixable")).drop("sure")
