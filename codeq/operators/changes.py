"""Changes as tables: acknowledge clicks, deletions, status events, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeq.operators.running import with_positions
from codeq.rules.catalogue import STATUSES

FIX_CONFIDENCE = 0.90


def acknowledged(toggles: DataFrame) -> DataFrame:
    """An issue is acknowledged after an odd number of clicks."""
    return toggles.groupBy("review_id", "issue_no").agg(
        (F.count("*") % 2 == 1).alias("is_acknowledged"))


def click_states(clicks: DataFrame, few: bool = False) -> DataFrame:
    """Clicks with a time ``at``, with their ``turn`` in their issue and whether it is acknowledged then.

    Those without a review or an issue number are left out. With ``few`` the clicks of an issue share a task,
    and nothing is shuffled where they are dealt by review; clicks are left out at the end, so that others who
    read them all read the same shuffle.
    """
    if few:
        so_far = Window.partitionBy("review_id", "issue_no").orderBy("at").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        known = F.col("review_id").isNotNull() & F.col("issue_no").isNotNull()
        return clicks.withColumn("turn", F.count(F.when(known, F.col("at"))).over(so_far)).filter(
            "turn > 0").withColumn("is_acknowledged", F.col("turn") % 2 == 1)
    timed = clicks.filter(F.col("at").isNotNull()).withColumn("minute", F.date_trunc("minute", "at"))
    return with_positions(timed, ["review_id", "issue_no"], ["minute"], ["at"], ["at"], "turn").drop(
        "minute").withColumn("is_acknowledged", F.col("turn") % 2 == 1)


def cascade(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Children whose parent was not deleted."""
    return children.join(deleted.select(key), key, "left_anti")


def cascade_review(deleted: DataFrame, files: DataFrame, issues: DataFrame,
                   suggestions: DataFrame) -> dict[str, DataFrame]:
    """What is left of files, issues and suggestions when reviews are deleted.

    Suggestions go with their issue (``issue_id``), the others with their review.
    """
    kept = cascade(issues, deleted, "review_id")
    return {"file": cascade(files, deleted, "review_id"), "issue": kept,
            "suggestion": suggestions.join(kept.select("issue_id"), "issue_id", "left_semi")}


def latest_status(events: DataFrame, today: Column) -> DataFrame:
    """Status of each review after its last event up to today, later statuses winning a tie.

    Day and status are packed into one number, which hash aggregation can keep in place.
    """
    number = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status")) - 1
    packed = F.unix_date("day").cast("long") * len(STATUSES) + number
    last = events.filter(F.col("day") <= today).groupBy("review_id").agg(F.max(packed).alias("p"))
    return last.select("review_id", F.get(
        F.array(*[F.lit(s) for s in STATUSES]),
        F.pmod("p", F.lit(len(STATUSES))).cast("int")).alias("status"))


def suggestions(findings: DataFrame) -> DataFrame:
    """A suggestion for each finding whose rule describes a fix."""
    return findings.filter(F.col("fix_description").isNotNull()).select(
        "file_id", "rule_id", "line_start", F.concat(F.lit("Auto-fix: "), "title").alias("title"),
        F.col("fix_description").alias("explanation"), F.lit(FIX_CONFIDENCE).alias("confidence"))
