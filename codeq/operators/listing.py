"""Filtered, ordered and paged lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from codeq.operators.rollups import author_totals, complete
from codeq.operators.running import ID_BLOCK, by_time, first_rows, with_positions
from codeq.operators.timeline import longest_streak, review_days, rolling_quality_exact
from codeq.rules.catalogue import SEVERITIES
from codeq.sources.sinks import read_back, write_table

PAGE_SIZE = 20
LAST_LINE = 2**31 - 1
LINE_BLOCK = 256
FEW_ROWS = 100_000  # what is sorted at once to cut out a page


def where_all(df: DataFrame, conditions: list[Column]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, conditions)) if conditions else df


def filter_issues(issues: DataFrame, severity: str | None = None, category: str | None = None,
                  fixable_only: bool = False, review_id: int | None = None) -> DataFrame:
    """Issues that meet every condition given."""
    conditions = []
    if review_id is not None:
        conditions.append(F.col("review_id") == review_id)
    if severity:
        conditions.append(F.col("severity") == severity)
    if category:
        conditions.append(F.col("category") == category)
    if fixable_only:
        conditions.append(F.col("is_fixable"))
    return where_all(issues, conditions)


def filter_reviews(reviews: DataFrame, author_id: int | None = None,
                   status: str | None = None) -> DataFrame:
    conditions = []
    if author_id is not None:
        conditions.append(F.col("author_id") == author_id)
    if status:
        conditions.append(F.col("status") == status)
    return where_all(reviews, conditions)


def severity_rank(severity: Column) -> Column:
    """4 for critical down to 1 for info."""
    position = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)
    return (len(SEVERITIES) + 1 - position).cast("int")


def order_issues(issues: DataFrame) -> DataFrame:
    """Issues with their place in their review: most serious first, then by line, no line last."""
    line = F.coalesce("line_start", F.lit(LAST_LINE))
    keyed = issues.withColumns({
        "severity_rank": severity_rank(F.col("severity")), "line_key": line,
        "line_block": F.floor(line / LINE_BLOCK), "block": F.substring("issue_id", 1, 1),
    })
    return with_positions(
        keyed, ["review_id"], ["-severity_rank", "line_block"], ["line_key", "rule_id", "block"],
        ["issue_id"]).drop("line_key", "line_block", "block")


def order_reviews(reviews: DataFrame) -> DataFrame:
    """Reviews with their place among their author's, newest first."""
    return with_positions(by_time(reviews, "created_at", "review_id"), ["author_id"], ["-minute"],
                          ["-created_at", "-block"], ["-review_id"]).drop("minute", "block")


def page_of_reviews(reviews: DataFrame, status: str | None = None, skip: int = 0,
                    limit: int = PAGE_SIZE) -> DataFrame:
    """One page of each author's reviews, newest first, with the author's total.

    The total counts all reviews of the author, whatever the status asked for.
    """
    upto = first_rows(filter_reviews(reviews, status=status), ["author_id"],
                      ["-created_at", "-review_id"], skip + limit)
    totals = reviews.groupBy("author_id").agg(F.count("*").alias("total"))
    return upto.filter(F.col("place") > skip).join(totals, "author_id")


def order_repositories(repositories: DataFrame) -> DataFrame:
    """Repositories with their place among their owner's, last updated first."""
    return with_positions(by_time(repositories, "updated_at", "repository_id"), ["owner_id"], ["-minute"],
                          ["-updated_at", "block"], ["repository_id"]).drop("minute", "block")


def taken_accounts(users: DataFrame) -> DataFrame:
    """Accounts whose username or e-mail another account has too."""
    shared = {}
    for column in ("username", "email"):
        shared[column] = users.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1").select(
            column, F.lit(True).alias(f"{column}_taken"))
    joined = users.select("user_id", "username", "email")
    for column, groups in shared.items():
        joined = joined.join(groups, column, "left")
    flagged = joined.select("user_id", *[
        F.coalesce(f"{c}_taken", F.lit(False)).alias(f"{c}_taken") for c in shared])
    return flagged.filter(F.col("username_taken") | F.col("email_taken"))


def leaderboard(users: DataFrame, reviews: DataFrame, issues: DataFrame, n: int = 10) -> DataFrame:
    """The active users with the best scores, ranked from 1, ties by user id.

    The board is found and written first; reviews, issues and days are then cut down to its ``n``
    users before anything is counted.
    """
    done = complete(reviews)
    scores = rolling_quality_exact(done).withColumnRenamed("author_id", "user_id")
    best = (
        users.filter("is_active").join(scores, "user_id", "left")
        .select("user_id", "username", "full_name", F.coalesce("quality_score", F.lit(0.0)).alias("quality_score"))
        .orderBy(F.col("quality_score").desc(), "user_id").limit(n)
    )
    best = read_back(users.sparkSession, write_table(best, purpose="board"))
    board = F.broadcast(best.select(F.col("user_id").alias("author_id")))  # n rows
    own = done.join(board, "author_id", "left_semi")
    found = issues.join(own.select("review_id"), "review_id", "left_semi")
    details = author_totals(found, own).withColumnRenamed("author_id", "user_id").join(
        longest_streak(review_days(own)), "user_id", "left")
    listed = best.join(details, "user_id", "left").fillna(
        0, ["total_reviews", "total_issues_found", "streak_days"])
    return first_rows(listed.withColumn("board", F.lit(1)), ["board"], ["-quality_score", "user_id"],
                      n, "rank").drop("board")


def _levels(time: str, number: str) -> list[tuple[Column, Column, str]]:
    """(time of a part, its block of numbers, how long it lasts), each level finer than the one before."""
    whole, block = F.lit(0).cast("long"), F.floor(F.col(number) / ID_BLOCK)
    return [*[(F.date_trunc(unit, time), whole, f"interval 1 {unit}") for unit in ("day", "minute", "millisecond")],
            (F.col(time), whole, "interval 1 microsecond"), (F.col(time), block, "interval 1 microsecond")]


def _beyond(time: str, kind: DataType, block: Column, part: Row, ahead: bool) -> Column:
    """Whether a row has the time of a part and lies in a block before it, or after it. Null blocks come last."""
    same = F.col(time).eqNullSafe(F.lit(part["start"]).cast(kind))
    if part["block"] is None:
        return same & block.isNotNull() if ahead else F.lit(False)
    return same & (F.coalesce(block > part["block"], F.lit(False)) if ahead
                   else F.coalesce(block < part["block"], F.lit(True)))


def page_at(rows: DataFrame, time: str, number: str, skip: int, limit: int = PAGE_SIZE) -> DataFrame:
    """The page after the first ``skip`` rows of the whole table, newest first, with each row's ``place``.

    Ties are broken by ``number``, a unique whole number, the larger first; rows without a time come last.
    The table is not sorted: counts per day tell in which days the page lies, then counts per minute
    of those days the minutes, and so on down to blocks of numbers at one time, until few rows are left.
    Each step reads its range only, and the driver gets one row per part of what the page touches.
    """
    kind = rows.schema[time].dataType
    ahead, inside = 0, rows
    for start, block, lasts in _levels(time, number):
        parts = inside.groupBy(start.alias("start"), block.alias("block")).agg(F.count("*").alias("n")).orderBy(
            F.col("start").desc_nulls_last(), F.col("block").desc_nulls_last())
        touched, seen = [], ahead
        for part in parts.withColumn("start", F.col("start").cast("string")).collect():
            if seen + part["n"] <= skip:
                ahead = seen + part["n"]
            elif seen < skip + limit:
                touched.append(part)
            seen += part["n"]
        if not touched:
            inside = rows.limit(0)
            break
        timed = [p["start"] for p in touched if p["start"] is not None]
        within = F.col(time).isNull() if len(timed) < len(touched) else F.lit(False)
        if timed:
            newest, oldest = (F.lit(x).cast(kind) for x in (timed[0], timed[-1]))
            within = within | ((F.col(time) >= oldest) & (F.col(time) < newest + F.expr(lasts)))
        inside = inside.filter(within)
        inside = inside.filter(~_beyond(time, kind, block, touched[0], True)
                               & ~_beyond(time, kind, block, touched[-1], False))
        if sum(p["n"] for p in touched) <= FEW_ROWS:
            break
    order = [F.col(time).desc_nulls_last(), F.col(number).desc_nulls_last()]
    page = inside.orderBy(*order).limit(skip - ahead + limit)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) + ahead
    return page.withColumn("place", place.cast("long")).filter(F.col("place") > skip)
