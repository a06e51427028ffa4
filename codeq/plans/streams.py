"""Streaming jobs run over all there is, then read back from where they wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeq.operators import timeline
from codeq.plans import sql as s
from codeq.plans.registry import query
from codeq.session import shared_folder
from codeq.sources import tables as t
from codeq.streaming import jobs


@query(s.with_ctes("matches", "SELECT review_id, file_id, rule_id, line_start FROM matches"))
def stream_findings(spark, folder):
    found = jobs.findings(t.files(spark, folder, stream=True))
    return spark.read.parquet(jobs.append(found, shared_folder(spark, "stream-findings")))


@query(s.with_ctes("done", """
    SELECT author_id, count(*) AS total_reviews, sum(total_lines)::BIGINT AS total_lines
    FROM done GROUP BY author_id"""))
def stream_author_totals(spark, folder):
    totals = jobs.author_totals(t.reviews(spark, folder, stream=True, status="complete"))
    out = jobs.update(totals, shared_folder(spark, "stream-totals"), "author_id")
    return jobs.latest(spark, out, "author_id")


@query(s.with_ctes("scores done", """
    SELECT d.author_id, quality_score, n_reviews FROM scores x
    JOIN (SELECT author_id, count(*) AS n_reviews FROM done GROUP BY author_id) d
         ON d.author_id = x.author_id"""))
def stream_rolling_quality(spark, folder):
    reviews = t.reviews(spark, folder, stream=True, status="complete")
    return jobs.rolling_scores(spark, jobs.rolling_quality(reviews, shared_folder(spark, "stream-rolling")))


@query(s.with_ctes("done", """
    SELECT author_id AS user_id, 1::BIGINT AS badge_id,
           strftime(min(created_at), '%Y-%m-%d') AS earned_on FROM done GROUP BY author_id"""))
def stream_badge_once(spark, folder):
    awards = jobs.first_badges(t.reviews(spark, folder, stream=True, status="complete"))
    out = jobs.update(awards, shared_folder(spark, "stream-badges"), "user_id", "badge_id")
    return jobs.latest(spark, out, "user_id", "badge_id").select(
        "user_id", "badge_id", F.date_format("earned_at", "yyyy-MM-dd").alias("earned_on"))


@query("""
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type,
           count(*) AS n
    FROM events GROUP BY ALL""")
def stream_window_counts(spark, folder):
    counts = jobs.window_counts(t.activity(spark, folder, stream=True))
    out = jobs.update(counts, shared_folder(spark, "stream-windows"), "window_start", "event_type")
    return jobs.latest(spark, out, "window_start", "event_type").withColumn(
        "window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


# Events reach the streams below in slices of eight days, some of them one or two slices late.
SLICES = 5
SLICE_OF = f"""
    SELECT *, least({SLICES - 3}, date_diff('day', TIMESTAMP '2024-01-01', ts) // 8)
              + CASE WHEN event_id % 50 = 0 THEN 2 WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS slice
    FROM events"""


def _slice() -> Column:
    behind = F.when(F.col("event_id") % 50 == 0, 2).when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    return F.least(F.lit(SLICES - 3), F.floor(F.date_diff("ts", F.lit("2024-01-01")) / 8)) + behind


def _in_slices(spark, folder: str, run, close_after: str | None = None) -> str:
    """Run a stream again for each slice of events that arrives, as its output says; then past them all."""
    activity, source = t.activity(spark, folder), shared_folder(spark, "arrivals")
    arrivals: list[DataFrame] = [activity.filter(_slice() == k) for k in range(SLICES)]
    if close_after:
        arrivals.append(jobs.heartbeat(activity, close_after))
    for slice in arrivals:
        slice.write.mode("append").parquet(source)
        out = run(spark.readStream.schema(activity.schema).parquet(source))
    return out


@query("""
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started_at,
           strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS ended_at, count(*) AS n_events
    FROM (SELECT *, count(*) FILTER (new) OVER own AS session
          FROM (SELECT user_id, event_id, ts, ts - lag(ts) OVER own > INTERVAL 30 MINUTE AS new
                FROM events WINDOW own AS (PARTITION BY user_id ORDER BY ts, event_id))
          WINDOW own AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    GROUP BY user_id, session""")
def stream_sessions(spark, folder):
    run = shared_folder(spark, "stream-sessions")
    out = _in_slices(spark, folder, lambda arrived: jobs.append_sessions(
        jobs.sessions(arrived, late="24 days"), run), close_after="30 days")
    return spark.read.parquet(out).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
                                                for c in ("started_at", "ended_at")})


LATE = f"""
    WITH arrivals AS ({SLICE_OF}),
    marks AS (
        SELECT slice, max(max(ts)) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                      - INTERVAL 1 DAY AS passed FROM arrivals GROUP BY slice),
    judged AS (
        SELECT a.*, date_trunc('hour', ts) AS window_start,
               coalesce(date_trunc('hour', ts) + INTERVAL 1 HOUR <= passed, false) AS too_late
        FROM arrivals a JOIN marks USING (slice))"""


def _windows(spark, folder) -> tuple[str, str]:
    run = shared_folder(spark, "stream-late")
    return _in_slices(spark, folder, lambda arrived: jobs.windows_and_late(arrived, run, late="1 day"))


@query(LATE + """
    SELECT strftime(window_start, '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n
    FROM judged WHERE NOT too_late
        AND window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL""")
def stream_closed_windows(spark, folder):
    return spark.read.parquet(_windows(spark, folder)[0]).withColumn(
        "window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query(LATE + "SELECT event_id, user_id, event_type, slice::BIGINT AS batch FROM judged WHERE too_late")
def stream_late_events(spark, folder):
    rows = jobs.late_rows(spark, _windows(spark, folder)[1])
    return rows.select("event_id", "user_id", "event_type", _slice().cast("long").alias("batch"))


@query(s.with_ctes("active_runs", """
    SELECT user_id, max(n_days) AS streak_days FROM active_runs GROUP BY user_id"""))
def stream_streaks(spark, folder):
    run = shared_folder(spark, "stream-streaks")
    out = _in_slices(spark, folder, lambda arrived: jobs.streaks(timeline.active_days(arrived), run))
    return jobs.longest_streaks(spark, out)


@query(s.with_ctes("code_lines", f"""
    SELECT review_id, n_lines, n_duplicated, {s.round_exact('pct', 1)} AS duplication_pct FROM pct""", pct="""
    SELECT review_id, sum(n)::BIGINT AS n_lines, sum(n - 1)::BIGINT AS n_duplicated,
           sum(n - 1)::DOUBLE / sum(n) * 100 AS pct
    FROM (SELECT review_id, count(*) AS n FROM code_lines WHERE file_id % 5 <> 0 GROUP BY review_id, stripped)
    GROUP BY review_id"""))
def stream_duplication(spark, folder):
    """Files come in three batches, and each fifth one goes again with the batch after its own."""
    files, run, source = t.files(spark, folder), shared_folder(spark, "stream-lines"), shared_folder(spark, "arrivals")
    comes, goes = F.col("file_id") % 3, F.col("file_id") % 5 == 0
    for k in range(4):
        files.filter(comes == k).withColumn("sign", F.lit(1)).union(
            files.filter(goes & (comes == k - 1)).withColumn("sign", F.lit(-1))).write.mode("append").parquet(source)
        jobs.duplication(spark.readStream.schema(files.withColumn("sign", F.lit(1)).schema).parquet(source), run)
    return jobs.duplication_now(spark, run)
