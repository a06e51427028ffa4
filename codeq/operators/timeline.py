"""Reviews and activity over time: trends, rolling scores, streaks, firsts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeq.functions.rounding import round_exact
from codeq.operators.rollups import SUMMED, complete
from codeq.operators.running import by_time, first_rows, running_totals

TREND_LENGTH = 10
TREND_TITLE = 30
RECENT = 5

# A score from 0 to 100 moves by at most 100/n when review n arrives, which from the 2001st review on
# is less than the 0.05 that rounding to one decimal needs to change it. So the first 2000 reviews of
# an author settle the rolling score, whatever follows. Scores outside that range are refused.
SETTLED_AFTER = 2000


def checked_score(score: Column) -> Column:
    """The score if it is 0 to 100, else an error."""
    return F.when(score.between(0, 100), score).otherwise(F.raise_error(
        F.concat(F.lit("a complete review needs a score from 0 to 100, not "),
                 F.coalesce(score.cast("string"), F.lit("null")))).cast("double"))


def quality_trend(reviews: DataFrame, n: int = TREND_LENGTH) -> DataFrame:
    """The last complete reviews of each author, renumbered from 1 in order of time."""
    last = first_rows(complete(reviews), ["author_id"], ["-created_at", "-review_id"], n)
    order = Window.partitionBy("author_id").orderBy(F.col("place").desc())
    return last.select(
        "author_id", F.row_number().over(order).cast("long").alias("review_num"), "review_id",
        F.substring("title", 1, TREND_TITLE).alias("title"),
        F.col("quality_score").alias("score"),
        F.date_format("created_at", "MMM dd").alias("date"))


def recent_reviews(reviews: DataFrame, n: int = RECENT) -> DataFrame:
    """The newest complete reviews of each author, newest first."""
    return first_rows(complete(reviews), ["author_id"], ["-created_at", "-review_id"], n)


def first_review(reviews: DataFrame) -> DataFrame:
    """Each author's first complete review."""
    first = F.min(F.struct("created_at", "review_id"))
    return complete(reviews).groupBy("author_id").agg(first.alias("f")).select(
        "author_id", "f.review_id", "f.created_at")


def rolling_quality(reviews: DataFrame) -> DataFrame:
    """Average score of an author's complete reviews up to and including each one.

    Scores are summed as decimals, so the result does not depend on the order of partial sums.
    """
    done = complete(reviews).select("author_id", "review_id", "created_at", "quality_score")
    running = running_totals(
        by_time(done, "created_at", "review_id"), ["author_id"], ["minute"], ["created_at", "block"],
        ["review_id"], {"n": F.lit(1).cast("long"), "total": F.col("quality_score").cast(SUMMED)})
    return running.select("author_id", "review_id", F.col("n").alias("review_num"),
                          (F.col("total").cast("double") / F.col("n")).alias("rolling_quality"))


def _fold(scores: Column) -> Column:
    """The rolling score after a list of scores, rounded to one decimal at every step."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("q"))

    def step(acc: Column, score: Column) -> Column:
        n = acc.n + 1
        mean = (acc.q * acc.n + score) / n
        # The array binds the mean to a name, as rounding uses it many times.
        rounded = F.transform(F.array(mean), lambda x: round_exact(x, 1))
        return F.struct(n.alias("n"), F.element_at(rounded, 1).alias("q"))

    return F.aggregate(scores, start, step, lambda acc: acc.q)


def first_reviews(scored: DataFrame, n: int = SETTLED_AFTER) -> DataFrame:
    """The first ``n`` of each author's reviews, by time and id.

    Of an author with more reviews only those up to the minute in which the ``n``-th falls are sorted: minutes are
    counted first, which combines before any shuffle, so no task gets more than ``n`` rows and one minute.
    """
    minute = F.date_trunc("minute", "created_at")
    counts = scored.groupBy("author_id", minute.alias("minute")).agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("author_id").orderBy("minute"))
    last = counts.withColumn("so_far", so_far).filter(F.col("so_far") >= n).groupBy("author_id").agg(
        F.min("minute").alias("last_minute"))
    near = scored.join(last, "author_id", "left").filter(
        F.col("last_minute").isNull() | (minute <= F.col("last_minute"))).drop("last_minute")
    place = F.row_number().over(Window.partitionBy("author_id").orderBy("created_at", "review_id"))
    return near.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def folded(first: DataFrame) -> DataFrame:
    """Each author's rolling score after the reviews given, rounded after each of them."""
    ordered = first.groupBy("author_id").agg(
        F.array_sort(F.collect_list(F.struct("created_at", "review_id", "quality_score"))).alias("steps"))
    return ordered.select(
        "author_id",
        _fold(F.transform("steps", lambda s: s.quality_score)).alias("quality_score"))


def rolling_quality_exact(reviews: DataFrame) -> DataFrame:
    """The score each author has after all complete reviews, rounded after each of them."""
    done = complete(reviews).select(
        "author_id", "created_at", "review_id", checked_score(F.col("quality_score")).alias("quality_score"))
    return folded(first_reviews(done))


def streaks(days: DataFrame) -> DataFrame:
    """Runs of consecutive days per user: user_id, first_day, last_day, n_days.

    Repeats of a day combine before the shuffle; what is left per user is at most one row a day.
    """
    distinct = days.groupBy("user_id", "day").agg(F.lit(1).alias("_"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("day"))
    return (
        distinct.withColumn("run", F.date_sub("day", place)).groupBy("user_id", "run")
        .agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"),
             F.count("*").alias("n_days")).drop("run")
    )


def joined_runs(runs: DataFrame) -> DataFrame:
    """Runs of days (user_id, first_day, last_day) that touch or overlap, joined; single days are runs.

    The result is the same whichever of them were joined before, so runs can be gathered part by part.
    """
    once = runs.groupBy("user_id", "first_day").agg(F.max("last_day").alias("last_day"))
    own = Window.partitionBy("user_id").orderBy("first_day")
    reached = F.max("last_day").over(own.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("first_day") > F.date_add(reached, 1), F.lit(True))
    return (once.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(own))
            .groupBy("user_id", "run").agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))
            .drop("run"))


def active_days(activity: DataFrame) -> DataFrame:
    return activity.select("user_id", F.to_date("ts").alias("day"))


def review_days(reviews: DataFrame) -> DataFrame:
    return complete(reviews).select(F.col("author_id").alias("user_id"),
                                    F.to_date("created_at").alias("day"))


def longest_streak(days: DataFrame) -> DataFrame:
    return streaks(days).groupBy("user_id").agg(F.max("n_days").alias("streak_days"))


def current_streak(days: DataFrame, today: Column) -> DataFrame:
    """Length of the run that reaches today or yesterday, else 0."""
    alive = F.col("last_day") >= F.date_sub(today, 1)
    return streaks(days.filter(F.col("day") <= today)).groupBy("user_id").agg(
        F.max(F.when(alive, F.col("n_days")).otherwise(0)).alias("streak_days"))
