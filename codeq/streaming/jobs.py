"""Incremental forms of the batch jobs, as Structured Streaming queries.

Each job names a folder for its output and its checkpoint and can be stopped and started again. What
a job updates is added per micro-batch to parts that are merged by level, once however often the batch
comes; ``latest`` reads back the last version of every key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from codeq.operators.duplication import added_up, duplication_of, line_changes
from codeq.operators.rollups import complete
from codeq.operators.scan import scan_rules
from codeq.operators.timeline import checked_score, first_reviews, folded, joined_runs
from codeq.streaming.merged import MergedParts, last_versions, sums

MERGE_SESSIONS = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def append(stream: DataFrame, folder: str) -> str:
    """Run an append-only stream over all that is there; returns where its rows are."""
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return f"{folder}/out"


def _each_batch(stream: DataFrame, folder: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    query = (stream.writeStream.foreachBatch(handle).outputMode(mode)
             .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()


def update(stream: DataFrame, folder: str, *keys: str) -> str:
    """Run an updating stream over all that is there; returns where its versions are."""
    def write(batch: DataFrame, batch_id: int) -> None:
        parts = MergedParts(batch.sparkSession, f"{folder}/out", last_versions(*keys))
        parts.add(batch.withColumn("batch_id", F.lit(batch_id)), batch_id)

    _each_batch(stream, folder, write, "update")
    return f"{folder}/out"


def latest(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The last version of every key an updating stream has written."""
    return MergedParts(spark, path, last_versions(*keys)).read().drop("batch_id")


def findings(files: DataFrame) -> DataFrame:
    """Findings of files as they arrive; stateless."""
    return scan_rules(files)


def author_totals(reviews: DataFrame) -> DataFrame:
    """Complete reviews and lines per author so far."""
    return complete(reviews).groupBy("author_id").agg(
        F.count("*").alias("total_reviews"), F.sum("total_lines").alias("total_lines"))


def first_badges(reviews: DataFrame) -> DataFrame:
    """The first-review badge, one row per author however many reviews come by.

    An aggregate rather than dropDuplicates, which would send every review of an author to the
    task that holds the author's state.
    """
    return complete(reviews).groupBy(F.col("author_id").alias("user_id")).agg(
        F.min("created_at").alias("earned_at")).withColumn("badge_id", F.lit(1).cast("long"))


def window_counts(activity: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per type and hour; events later than the watermark are left out."""
    timed = activity.withColumn("ts", F.col("ts").cast("timestamp"))
    return (timed.withWatermark("ts", late)
            .groupBy(F.window("ts", length).alias("w"), "event_type")
            .agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("window_start"), "event_type", "n"))


def sessions(activity: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Sessions of users: events of which none is more than ``gap`` after the one before.

    Rows: user_id, started_at, ended_at (the last event), n_events. An event that comes late joins what
    lies on both sides of it, as long as it is not later than the watermark. A session is given once, when
    the watermark has passed its end. Events without time belong to none; those without user to one user.
    """
    timed = activity.withColumn("ts", F.col("ts").cast("timestamp"))
    return (timed.withWatermark("ts", late)
            .groupBy("user_id", F.session_window("ts", gap).alias("s"))
            .agg(F.count("*").alias("n_events"))
            .select("user_id", F.col("s.start").alias("started_at"),
                    (F.col("s.end") - F.expr(f"interval {gap}")).alias("ended_at"), "n_events"))


def append_sessions(stream: DataFrame, folder: str) -> str:
    """Run ``sessions``; each task merges its own events first, so a hot user comes as few rows."""
    conf = stream.sparkSession.conf
    before = conf.get(MERGE_SESSIONS, None)
    conf.set(MERGE_SESSIONS, "true")
    try:
        return append(stream, folder)
    finally:
        if before is None:
            conf.unset(MERGE_SESSIONS)
        else:
            conf.set(MERGE_SESSIONS, before)


def heartbeat(activity: DataFrame, after: str) -> DataFrame:
    """A row without user or type, ``after`` later than all: moves the watermark past what is there."""
    times = activity.agg((F.max("ts") + F.expr(f"interval {after}")).alias("ts"))
    return times.select(*[F.col("ts").cast(t).alias(c) if c == "ts" else F.lit(None).cast(t).alias(c)
                          for c, t in activity.dtypes])


def split_late(activity: DataFrame, folder: str, length: str = "1 hour", late: str = "10 minutes") -> str:
    """Write rows by whether their window had ended, by the watermark, before their micro-batch.

    The watermark of a batch is the greatest time of all earlier ones less ``late``. Each batch writes its
    rows to its own folder, parted by ``too_late``, and leaves the greatest time so far, which a repeated
    batch finds again. Rows without time are too late. Returns where the rows are.
    """
    spark = activity.sparkSession
    high = "high timestamp"

    def write(batch: DataFrame, batch_id: int) -> None:
        marks = spark.read.schema(high).parquet(f"{folder}/marks/batch_id={batch_id - 1}").first() if batch_id else None
        before = marks["high"] if marks else None
        seen = Observation()
        timed = batch.withColumn("ts", F.col("ts").cast("timestamp")).observe(seen, F.max("ts").alias("high"))
        passed = F.lit(before).cast("timestamp") - F.expr(f"interval {late}")
        ended = F.coalesce(F.window("ts", length).end <= passed, F.lit(False))
        # window() leaves out rows without time, so they are judged apart
        rows = timed.filter("ts is not null").withColumn("too_late", ended).unionByName(
            timed.filter("ts is null").withColumn("too_late", F.lit(True)))
        rows.write.mode("overwrite").partitionBy("too_late").parquet(f"{folder}/rows/batch_id={batch_id}")
        now = max((x for x in (before, seen.get["high"]) if x is not None), default=None)
        spark.createDataFrame([(now,)], high).coalesce(1).write.mode("overwrite").parquet(
            f"{folder}/marks/batch_id={batch_id}")

    _each_batch(activity, folder, write)
    return f"{folder}/rows"


def windows_and_late(activity: DataFrame, folder: str, length: str = "1 hour",
                     late: str = "10 minutes") -> tuple[str, str]:
    """Run windowed counts in append mode, and keep the rows that came too late to be counted.

    Returns where the counts of ended windows are, each given once, and where all rows are with ``too_late``.
    Every row is either counted, or still waits in an open window, or is too late: the counting stream reads
    the rows that ``split_late`` let through, in the same order, so its own watermark is never ahead.
    """
    spark = activity.sparkSession
    rows = split_late(activity, f"{folder}/split", length, late)
    kinds = ", ".join(f"{c} {'timestamp' if c == 'ts' else t}" for c, t in activity.dtypes)
    on_time = spark.readStream.schema(f"{kinds}, batch_id long, too_late boolean").parquet(rows).filter("not too_late")
    return append(window_counts(on_time, length, late), f"{folder}/counts"), rows


def late_rows(spark: SparkSession, rows: str) -> DataFrame:
    """The rows that came too late, from where ``split_late`` put them."""
    return spark.read.parquet(rows).filter("too_late = 'true'").drop("too_late", "batch_id")


def rolling_quality(reviews: DataFrame, folder: str) -> str:
    """Keep what each author's rolling score needs, of reviews in any order and any cut into batches.

    The score is rounded after every review in order of time, so a late review changes all that follow. But
    it is settled by an author's first reviews, and the first of all are among the first of each batch:
    these, and counts, are gathered; ``rolling_scores`` folds them.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        counts = batch.groupBy("author_id").agg(F.count("*").alias("n_reviews"))
        MergedParts(spark, f"{folder}/first", first_reviews).add(batch, batch_id)
        MergedParts(spark, f"{folder}/counts", sums("author_id")).add(counts, batch_id)

    _each_batch(complete(reviews).select(
        "author_id", "review_id", "created_at", checked_score(F.col("quality_score")).alias("quality_score")),
        folder, write)
    return folder


def rolling_scores(spark: SparkSession, folder: str) -> DataFrame:
    """author_id, quality_score and n_reviews after all reviews that ``rolling_quality`` has seen."""
    first = MergedParts(spark, f"{folder}/first", first_reviews).read()
    counts = MergedParts(spark, f"{folder}/counts", sums("author_id")).read()
    return folded(first).join(counts, "author_id")


def streaks(days: DataFrame, folder: str) -> str:
    """Keep each user's runs of days, of days (user_id, day) in any order, late and repeated ones too.

    A late day joins the runs on both its sides. Rows without a day count for nothing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        runs = batch.filter("day is not null").select(
            "user_id", F.col("day").alias("first_day"), F.col("day").alias("last_day"))
        MergedParts(batch.sparkSession, folder + "/runs", joined_runs).add(runs, batch_id)

    _each_batch(days, folder, write)
    return folder


def longest_streaks(spark: SparkSession, folder: str) -> DataFrame:
    """user_id and streak_days after all days that ``streaks`` has seen."""
    runs = MergedParts(spark, folder + "/runs", joined_runs).read()
    length = F.date_diff("last_day", "first_day") + 1
    return runs.groupBy("user_id").agg(F.max(length).cast("long").alias("streak_days"))


def duplication(changes: DataFrame, folder: str) -> str:
    """Keep counts of lines per review, of files that come (``sign`` 1) and go (``sign`` -1).

    A file that goes, or changes, comes once more with the content that it had. The order does not matter:
    a file may go before it came.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        MergedParts(batch.sparkSession, folder + "/lines", added_up).add(line_changes(batch), batch_id)

    _each_batch(changes, folder, write)
    return folder


def duplication_now(spark: SparkSession, folder: str) -> DataFrame:
    """review_id, n_lines, n_duplicated and duplication_pct of the files that are there now."""
    return duplication_of(MergedParts(spark, folder + "/lines", added_up).read())
