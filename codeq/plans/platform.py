"""Queries over users, reviews, issues and activity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeq.functions import presentation as p
from codeq.functions.metrics import extension
from codeq.operators import asof, audits, badges, changes, listing, nested, rollups, running, timeline
from codeq.operators import findings as findings_of
from codeq.operators import metrics as metrics_of
from codeq.plans import corpus
from codeq.plans import sql as s
from codeq.plans.registry import query
from codeq.rules.catalogue import CATEGORIES, LANGUAGES, SEVERITIES, STATUSES, badges_frame
from codeq.sources import tables as t
from codeq.sources.sinks import read_back, write_findings, write_table

TODAY = "2024-01-30"
NOW = "2024-01-31 00:00:00"
BADGES_UNTIL = "1999-01-01"
STATUS_DAY = "2001-01-01"


def _done(spark, folder):
    return t.reviews(spark, folder, status="complete")


def _held(spark, folder):
    return badges.user_badges(t.reviews(spark, folder), t.issues(spark, folder),
                              t.toggles(spark, folder))


# Lists ------------------------------------------------------------------------------------------

@query(s.with_ctes("v_reviews", """
    SELECT author_id, review_id, status, row_number() OVER (
        PARTITION BY author_id ORDER BY created_at DESC, review_id DESC) AS position
    FROM v_reviews"""))
def reviews_by_author(spark, folder):
    return listing.order_reviews(t.reviews(spark, folder)).select(
        "author_id", "review_id", "status", "position")


@query(s.with_ctes("done", "SELECT review_id, author_id, quality_score FROM done"))
def completed_reviews(spark, folder):
    return listing.filter_reviews(_done(spark, folder), status="complete").select(
        "review_id", "author_id", "quality_score")


@query(s.with_ctes("v_users", """
    SELECT user_id, username IN (SELECT username FROM v_users GROUP BY 1 HAVING count(*) > 1)
               AS username_taken,
           email IN (SELECT email FROM v_users GROUP BY 1 HAVING count(*) > 1) AS email_taken
    FROM v_users WHERE username_taken OR email_taken"""))
def duplicate_accounts(spark, folder):
    return listing.taken_accounts(t.users(spark, folder))


@query(s.with_ctes("v_issues", """
    SELECT issue_id, review_id, rule_id FROM v_issues
    WHERE severity = 'critical' AND category = 'security' AND is_fixable"""))
def issues_filtered(spark, folder):
    return listing.filter_issues(
        t.issues(spark, folder), severity="critical", category="security", fixable_only=True
    ).select("issue_id", "review_id", "rule_id")


@query(s.with_ctes("v_users", "SELECT user_id, username FROM v_users WHERE is_active"))
def active_users(spark, folder):
    return t.users(spark, folder).filter("is_active").select("user_id", "username")


@query(s.with_ctes("v_issues", """
    SELECT issue_id, review_id, file_no FROM v_issues WHERE (review_id, file_no) IN (
        SELECT (review_id, file_no) FROM v_issues WHERE severity = 'critical')"""))
def issues_of_file(spark, folder):
    """All issues of the files that hold a critical one."""
    issues = t.issues(spark, folder)
    selected = issues.filter(F.col("severity") == "critical").select(
        "review_id", "file_no").distinct()
    return issues.join(selected, ["review_id", "file_no"], "left_semi").select(
        "issue_id", "review_id", "file_no")


@query(s.with_ctes("v_issues severities", """
    SELECT issue_id, review_id, severity_rank, row_number() OVER (
        PARTITION BY review_id ORDER BY severity_rank DESC, line_start ASC NULLS LAST, rule_id,
        issue_id) AS position
    FROM v_issues JOIN severities USING (severity)"""))
def issues_ordered(spark, folder):
    return listing.order_issues(t.issues(spark, folder)).select(
        "issue_id", "review_id", "severity_rank", "position")


@query(s.with_ctes("v_reviews done", """
    SELECT d.author_id, review_id, place, total
    FROM (SELECT author_id, review_id, row_number() OVER (
              PARTITION BY author_id ORDER BY created_at DESC, review_id DESC) AS place
          FROM done) d
    JOIN (SELECT author_id, count(*) AS total FROM v_reviews GROUP BY author_id) a
         ON a.author_id = d.author_id
    WHERE place > 2 AND place <= 7"""))
def reviews_page(spark, folder):
    return listing.page_of_reviews(
        t.reviews(spark, folder), status="complete", skip=2, limit=5
    ).select("author_id", "review_id", F.col("place").cast("long").alias("place"), "total")


@query(s.with_ctes("v_reviews", """
    SELECT review_id, author_id, place FROM (
        SELECT review_id, author_id, row_number() OVER (ORDER BY created_at DESC, review_id DESC) AS place
        FROM v_reviews)
    WHERE place > 1000 AND place <= 1020"""))
def reviews_deep_page(spark, folder):
    """The page after the newest thousand reviews of all authors."""
    return listing.page_at(t.reviews(spark, folder), "created_at", "review_id", skip=1000).select(
        "review_id", "author_id", "place")


@query(s.with_ctes("v_repositories", """
    SELECT repository_id, owner_id, name, row_number() OVER (
        PARTITION BY owner_id ORDER BY updated_at DESC, repository_id) AS position
    FROM v_repositories"""))
def repos_list(spark, folder):
    return listing.order_repositories(t.repositories(spark, folder)).select(
        "repository_id", "owner_id", "name", "position")


# Joins ------------------------------------------------------------------------------------------

@query(s.with_ctes("held", "SELECT user_id, slug, name, description,"
                   " strftime(earned_at, '%Y-%m-%d') AS earned_on FROM held"))
def user_badges_join(spark, folder):
    return badges.with_badge_details(_held(spark, folder)).select(
        "user_id", "slug", "name", "description",
        F.date_format("earned_at", "yyyy-MM-dd").alias("earned_on"))


@query(s.with_ctes("v_authored", "SELECT issue_id, author_id, rule_id, severity FROM v_authored"))
def issues_of_author(spark, folder):
    return t.issues(spark, folder).join(
        t.reviews(spark, folder).select("review_id", "author_id"), "review_id"
    ).select("issue_id", "author_id", "rule_id", "severity")


@query(s.with_ctes("v_issues v_reviews v_users", """
    SELECT issue_id FROM v_issues WHERE review_id IN (
        SELECT review_id FROM v_reviews JOIN v_users ON author_id = user_id WHERE is_active)"""))
def owned_issues(spark, folder):
    """Issues in reviews of active users."""
    active = t.users(spark, folder).filter("is_active").select(F.col("user_id").alias("author_id"))
    owned = t.reviews(spark, folder).join(active, "author_id", "left_semi").select("review_id")
    return t.issues(spark, folder).join(owned, "review_id", "left_semi").select("issue_id")


@query(s.with_ctes("v_reviews severities v_issues", """
    SELECT r.review_id, s.severity, count(issue_id) AS n
    FROM v_reviews r CROSS JOIN severities s
    LEFT JOIN v_issues i ON i.review_id = r.review_id AND i.severity = s.severity
    GROUP BY ALL"""))
def severity_zero_filled(spark, folder):
    return rollups.severities_by_review(t.issues(spark, folder), t.reviews(spark, folder))


@query(s.with_ctes("v_reviews v_repositories", """
    SELECT review_id, r.repository_id, name FROM v_reviews r
    LEFT JOIN v_repositories p ON r.repository_id = p.repository_id"""))
def reviews_with_repo(spark, folder):
    return rollups.with_repository(
        t.reviews(spark, folder), t.repositories(spark, folder)
    ).select("review_id", "repository_id", "name")


# Roll-ups ---------------------------------------------------------------------------------------

@query(s.with_ctes("v_users done v_issues", """
    SELECT (SELECT count(*) FROM v_users WHERE is_active) AS total_users,
           (SELECT count(*) FROM done) AS total_reviews,
           (SELECT count(*) FROM v_issues) AS total_issues_found"""))
def global_stats(spark, folder):
    return rollups.global_stats(t.issues(spark, folder), t.reviews(spark, folder),
                                t.users(spark, folder))


@query(s.with_ctes("v_authored",
                   "SELECT author_id, category, count(*) AS n FROM v_authored GROUP BY ALL"))
def issues_by_category(spark, folder):
    return rollups.categories_by_author(t.issues(spark, folder), t.reviews(spark, folder)).drop(
        "pct")


@query(s.with_ctes("v_users severities v_authored", """
    SELECT user_id AS author_id, s.severity, count(issue_id) AS n
    FROM v_users CROSS JOIN severities s
    LEFT JOIN v_authored i ON author_id = user_id AND i.severity = s.severity GROUP BY ALL"""))
def issues_by_severity(spark, folder):
    return rollups.severities_by_author(
        t.issues(spark, folder), t.reviews(spark, folder), t.users(spark, folder))


@query(s.with_ctes("v_authored", """
    SELECT author_id, category, count(*) / sum(count(*)) OVER (PARTITION BY author_id) * 100 AS pct
    FROM v_authored GROUP BY author_id, category"""))
def category_share(spark, folder):
    return rollups.categories_by_author(t.issues(spark, folder), t.reviews(spark, folder)).drop("n")


@query(s.with_ctes("top", "SELECT author_id, rule_id, title, severity, n FROM top"))
def top_rules(spark, folder):
    return rollups.top_rules(t.issues(spark, folder), t.reviews(spark, folder)).drop("place")


@query(s.with_ctes("author_stats", "SELECT * FROM author_stats"))
def author_stats(spark, folder):
    return rollups.author_stats(
        t.issues(spark, folder), t.reviews(spark, folder), t.users(spark, folder))


@query(s.with_ctes("totals", "SELECT * FROM totals"))
def author_totals(spark, folder):
    return rollups.author_totals(t.issues(spark, folder), _done(spark, folder))


REPO_MEANS = """
    SELECT repository_id, count(*) AS total_reviews, avg(quality_score) AS mean,
           sum(coalesce(n, 0))::BIGINT AS total_issues, {more}
    FROM done d LEFT JOIN (SELECT review_id, count(*) AS n, {counts}
                           FROM v_issues GROUP BY review_id) i ON d.review_id = i.review_id
    WHERE repository_id IS NOT NULL GROUP BY repository_id"""


def _repo_sql(select: str) -> str:
    names = [*SEVERITIES, *CATEGORIES]
    return s.with_ctes("done v_issues", select, repo=REPO_MEANS.format(
        more=", ".join(f"sum(coalesce({x}, 0))::BIGINT AS {x}" for x in names),
        counts=", ".join(
            [f"count(*) FILTER (severity = '{x}') AS {x}" for x in SEVERITIES]
            + [f"count(*) FILTER (category = '{x}') AS {x}" for x in CATEGORIES])))


@query(_repo_sql(f"SELECT repository_id, total_reviews,"
                 f" {s.round_exact('mean', 1)} AS avg_quality_score, total_issues FROM repo"))
def repo_rollup(spark, folder):
    return rollups.repository_rollup(t.issues(spark, folder), _done(spark, folder)).drop(
        "issues_by_severity", "issues_by_category")


@query(_repo_sql(
    "SELECT repository_id, '{' || concat_ws(',', " + ", ".join(
        f"""'"{x}":' || {x}""" for x in SEVERITIES) + ") || '}' AS issues_by_severity,"
    " '{' || concat_ws(',', " + ", ".join(
        f"""CASE WHEN {x} > 0 THEN '"{x}":' || {x} END""" for x in CATEGORIES)
    + ") || '}' AS issues_by_category FROM repo"))
def repo_rollup_maps(spark, folder):
    rolled = rollups.repository_rollup(t.issues(spark, folder), _done(spark, folder))
    return nested.as_json(
        rolled.select("repository_id", "issues_by_severity", "issues_by_category"),
        "issues_by_severity", "issues_by_category")


@query(s.with_ctes("fixed", "SELECT author_id, issues_fixed FROM fixed"))
def issues_fixed(spark, folder):
    return badges.issues_fixed(t.toggles(spark, folder), t.reviews(spark, folder))


@query(s.with_ctes("v_issues", """
    SELECT category, count(*) AS n, count(*) FILTER (is_fixable) AS n_fixable,
           count(*) FILTER (is_fixable) / count(*) AS coverage,
           (sum(0.9::DECIMAL(38, 10)) FILTER (is_fixable))::DOUBLE / count(*) FILTER (is_fixable)
               AS avg_confidence
    FROM v_issues GROUP BY category"""))
def fix_coverage(spark, folder):
    return rollups.fix_coverage(t.issues(spark, folder))


# Time -------------------------------------------------------------------------------------------

def _board(spark, folder):
    return listing.leaderboard(
        t.users(spark, folder), _done(spark, folder), t.issues(spark, folder)
    ).withColumn("rank", F.col("rank").cast("long"))


BOARD = """
    SELECT row_number() OVER (ORDER BY coalesce(quality_score, 0) DESC, u.user_id) AS rank,
           u.user_id, username, full_name, coalesce(quality_score, 0.0::DOUBLE) AS quality_score,
           coalesce(total_reviews, 0) AS total_reviews,
           coalesce(total_issues_found, 0) AS total_issues_found,
           coalesce(streak_days, 0) AS streak_days
    FROM v_users u LEFT JOIN scores x ON x.author_id = u.user_id
    LEFT JOIN totals t ON t.author_id = u.user_id
    LEFT JOIN review_streaks r ON r.user_id = u.user_id
    WHERE is_active ORDER BY rank LIMIT 10"""


@query(s.with_ctes("v_users scores totals review_streaks", "SELECT * FROM board", board=BOARD))
def leaderboard(spark, folder):
    return _board(spark, folder)


@query(s.with_ctes("v_users scores totals review_streaks", """
    SELECT rank, user_id, CASE rank WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' WHEN 3 THEN 'bronze'
    END AS medal FROM board""", board=BOARD))
def leaderboard_medals(spark, folder):
    return _board(spark, folder).select("rank", "user_id", p.medal(F.col("rank")).alias("medal"))


@query(s.with_ctes("trend", "SELECT * FROM trend"))
def quality_trend(spark, folder):
    return timeline.quality_trend(_done(spark, folder))


@query(s.with_ctes("done", """
    SELECT author_id, review_id, row_number() OVER (
        PARTITION BY author_id ORDER BY created_at DESC, review_id DESC) AS place
    FROM done QUALIFY place <= 5"""))
def recent_reviews(spark, folder):
    return timeline.recent_reviews(_done(spark, folder)).select(
        "author_id", "review_id", F.col("place").cast("long").alias("place"))


@query(s.with_ctes("done", """
    SELECT author_id, review_id,
           row_number() OVER w AS review_num, avg(quality_score) OVER w AS rolling_quality
    FROM done WINDOW w AS (PARTITION BY author_id ORDER BY created_at, review_id
                           ROWS UNBOUNDED PRECEDING)"""))
def rolling_quality(spark, folder):
    return timeline.rolling_quality(_done(spark, folder))


@query(s.with_ctes("scores", "SELECT * FROM scores"))
def rolling_quality_exact(spark, folder):
    return timeline.rolling_quality_exact(_done(spark, folder))


@query(s.with_ctes("active_runs",
                   "SELECT user_id, max(n_days) AS streak_days FROM active_runs GROUP BY user_id"))
def streak_days(spark, folder):
    return timeline.longest_streak(timeline.active_days(t.activity(spark, folder)))


@query(s.with_ctes("active_runs", f"""
    SELECT user_id, max(CASE WHEN last_day >= DATE '{TODAY}' - 1 THEN n_days ELSE 0 END)
           AS streak_days FROM active_runs GROUP BY user_id"""))
def current_streak(spark, folder):
    return timeline.current_streak(timeline.active_days(t.activity(spark, folder)),
                                   F.lit(TODAY).cast("date"))


@query(s.with_ctes("done", """
    SELECT author_id, review_id FROM done
    QUALIFY row_number() OVER (PARTITION BY author_id ORDER BY created_at, review_id) = 1"""))
def first_review(spark, folder):
    return timeline.first_review(_done(spark, folder)).select("author_id", "review_id")


# Badges -----------------------------------------------------------------------------------------

@query(s.with_ctes("held badges", """
    SELECT b.badge_id, b.slug, b.name, count(user_id) AS n_holders
    FROM badges b LEFT JOIN held h ON h.badge_id = b.badge_id GROUP BY ALL"""))
def dim_badges(spark, folder):
    """The badges, with the number of users who hold each."""
    return badges.badge_holders(_held(spark, folder)).select(
        "badge_id", "slug", "name", "n_holders")


@query(s.with_ctes("held", "SELECT user_id, badge_id, slug FROM held"))
def badge_awards(spark, folder):
    metrics = badges.author_metrics(t.reviews(spark, folder), t.issues(spark, folder),
                                    t.toggles(spark, folder))
    return badges.badge_awards(metrics).select("user_id", "badge_id", "slug")


@query(s.with_ctes("held done", f"""
    SELECT user_id, badge_id FROM held h WHERE NOT (badge_id = 1 AND user_id IN (
        SELECT author_id FROM done WHERE created_at < TIMESTAMP '{BADGES_UNTIL}'))"""))
def badges_to_award(spark, folder):
    """Awards not held yet, given that first-review badges went out until some day."""
    early = t.reviews(spark, folder).filter(
        F.col("created_at") < F.lit(BADGES_UNTIL).cast("timestamp_ntz"))
    held = timeline.first_review(early).select(
        F.col("author_id").alias("user_id"), F.lit(1).cast("long").alias("badge_id"))
    return badges.not_held(_held(spark, folder), held).select("user_id", "badge_id")


@query(s.with_ctes("done v_users", """
    SELECT author_id AS user_id, 1::BIGINT AS badge_id FROM done
    WHERE author_id NOT IN (SELECT user_id FROM v_users WHERE NOT is_active)
    GROUP BY author_id HAVING count(*) = 1"""))
def first_review_badge(spark, folder):
    """Who gets the badge, given that every inactive user holds one already."""
    held = t.users(spark, folder).filter("not is_active").select(
        "user_id", F.lit(1).cast("long").alias("badge_id"))
    return badges.first_review_awards(t.reviews(spark, folder), held)


@query(s.with_ctes("held", """
    SELECT user_id, badge_id, row_number() OVER (
        PARTITION BY user_id ORDER BY earned_at DESC, badge_id) AS place
    FROM held QUALIFY place <= 4"""))
def badge_top4(spark, folder):
    return badges.newest_badges(_held(spark, folder)).select(
        "user_id", "badge_id", F.col("place").cast("long").alias("place"))


# Labels -----------------------------------------------------------------------------------------

@query(s.with_ctes("v_reviews", f"""
    SELECT review_id, {s.band('quality_score', p.SCORE_LABELS, 'Critical')} AS label
    FROM v_reviews"""))
def score_label(spark, folder):
    return t.reviews(spark, folder).select(
        "review_id", p.score_label(F.col("quality_score")).alias("label"))


@query(s.with_ctes("v_reviews", f"""
    SELECT review_id, {s.band('quality_score', p.SCORE_BANDS, 'critical')} AS band FROM v_reviews"""))
def score_band(spark, folder):
    return t.reviews(spark, folder).select(
        "review_id", p.score_band(F.col("quality_score")).alias("band"))


@query(f"""
    WITH ages AS (SELECT event_id, floor(epoch(TIMESTAMP '{NOW}' - ts) / 60)::BIGINT AS m
                  FROM events)
    SELECT event_id, CASE WHEN m >= 1440 THEN (m // 1440) || 'd ago'
                          WHEN m >= 60 THEN (m // 60) || 'h ago'
                          WHEN m > 0 THEN m || 'm ago' ELSE 'Just now' END AS age FROM ages""")
def time_ago(spark, folder):
    return t.activity(spark, folder).select(
        "event_id", p.time_ago(F.col("ts"), F.lit(NOW).cast("timestamp_ntz")).alias("age"))


@query(f"""
    WITH d AS (SELECT event_id, floor(value * 100)::BIGINT AS ms,
                      floor(value * 100) / 1000.0::DOUBLE AS s FROM events)
    SELECT event_id, CASE WHEN ms < 1000 THEN ms || 'ms'
           ELSE printf('%.1f', {s.round_exact('s', 1, 'up')}) || 's' END AS duration FROM d""")
def fmt_duration(spark, folder):
    ms = F.floor(F.col("value") * 100)
    return t.activity(spark, folder).select("event_id", ms.alias("ms")).select(
        "event_id", p.duration_text(F.col("ms")).alias("duration"))


@query(s.with_ctes("v_users", f"""
    SELECT user_id, first_name, format('{{:,}}', lines) AS lines,
           printf('%.1f', {s.round_exact('kb', 1, 'up')}) || ' KB' AS size FROM shown""", shown="""
    SELECT user_id, split_part(full_name, ' ', 1) AS first_name, coalesce(sum(q), 0)::BIGINT AS lines,
           coalesce(sum(q), 0)::BIGINT / 1024.0::DOUBLE AS kb
    FROM v_users LEFT JOIN (SELECT o_custkey, floor(o_totalprice)::BIGINT AS q FROM orders) o
         ON o_custkey = user_id GROUP BY ALL"""))
def display_scalars(spark, folder):
    """First name, and the summed order value as a number of lines and as a file size."""
    sums = t.table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.sum(F.floor("o_totalprice")).alias("q"))
    shown = t.users(spark, folder).join(sums, "user_id", "left").fillna(0, ["q"])
    return shown.select(
        "user_id", p.first_name(F.col("full_name")).alias("first_name"),
        F.format_number("q", 0).alias("lines"), p.kilobytes_text(F.col("q")).alias("size"))


@query(s.with_ctes("v_files", f"""
    SELECT file_id, CASE WHEN ext IN ({', '.join(map(s.quote, LANGUAGES))}) THEN ext
                         ELSE 'unknown' END AS language FROM v_files"""))
def coerce_language(spark, folder):
    """The extension taken for a language name, where it is one."""
    return t.files(spark, folder).select(
        "file_id", p.coerce(extension(F.col("filename")), LANGUAGES).alias("language"))


# Documents --------------------------------------------------------------------------------------

def _detail(spark, folder):
    """Files of reviews as documents, put together from a written table of findings.

    The text is read once: metrics, text and findings of each file are written, and all that is joined comes from there.
    """
    measured = read_back(spark, write_table(metrics_of.metrics_with_findings(t.files(spark, folder)), purpose="measured"))
    found = measured.select("review_id", "file_id", F.explode("found").alias("f")).select("review_id", "file_id", "f.*")
    findings = read_back(spark, write_findings(found))
    detail = nested.review_detail(
        measured.select("file_id", "content"), measured.drop("content", "found"), corpus.comparable(findings))
    return detail.select(*corpus.FILE_METRICS, "content", "issues", "annotations")


DETAIL = {
    "issue_lists": """
    SELECT file_id, list(struct_pack(
               line_start := line_start, rule_id := rule_id, category := category, severity := severity,
               title := title, message := message, line_end := line_end, code_snippet := code_snippet,
               is_fixable := is_fixable, fix_description := fix_description,
               suggestions := CASE WHEN fix_description IS NULL THEN [] ELSE [struct_pack(
                   title := 'Auto-fix: ' || title, explanation := fix_description,
                   confidence := 0.9::DOUBLE)] END)
           ORDER BY line_start NULLS FIRST, rule_id, category, severity, title, message NULLS FIRST,
               line_end NULLS FIRST, code_snippet NULLS FIRST) AS issues
    FROM full_findings GROUP BY file_id""",
    "label_lists": """
    SELECT file_id, line_start::VARCHAR AS line,
           list('[' || upper(severity) || '] ' || title ORDER BY '[' || upper(severity) || '] ' || title) AS labels
    FROM full_findings WHERE line_start IS NOT NULL GROUP BY ALL""",
    "notes": """
    SELECT file_id, map(list(line ORDER BY line), list(labels ORDER BY line)) AS notes
    FROM label_lists GROUP BY file_id""",
    "detail": f"""
    SELECT {', '.join(f'm.{c}' for c in corpus.FILE_METRICS)}, content,
           coalesce(to_json(issues)::VARCHAR, '[]') AS issues,
           coalesce(to_json(notes)::VARCHAR, '{{}}') AS annotations
    FROM file_metrics m JOIN v_files f ON m.file_id = f.file_id
    LEFT JOIN issue_lists i ON i.file_id = m.file_id LEFT JOIN notes n ON n.file_id = m.file_id""",
}


@query(s.with_ctes("file_metrics v_files full_findings", "SELECT * FROM detail", **DETAIL))
def review_detail(spark, folder):
    return nested.as_json(_detail(spark, folder), "issues", "annotations")


@query(s.with_ctes("file_metrics v_files full_findings", f"""
    SELECT review_id, file_id, '{{' || concat_ws(',', {', '.join(
        f"""'"{c}":' || to_json({c})::VARCHAR""" for c in (*corpus.FILE_METRICS, 'content'))},
        '"issues":' || issues, '"annotations":' || annotations) || '}}' AS report
    FROM detail""", **DETAIL))
def report_json(spark, folder):
    """Each file of each review as one JSON document."""
    return _detail(spark, folder).select(
        "review_id", "file_id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("report"))


BADGE_LISTS = """
    SELECT user_id, to_json(list(struct_pack(slug := slug, name := name, description := description,
           earned_at := strftime(earned_at, '%Y-%m-%dT%H:%M:%S')) ORDER BY badge_id))::VARCHAR AS b
    FROM held GROUP BY user_id"""


@query(s.with_ctes("v_users scores totals review_streaks fixed held done v_issues", """
    SELECT u.user_id, username, full_name, coalesce(quality_score, 0.0::DOUBLE) AS quality_score,
           coalesce(total_reviews, 0) AS total_reviews,
           coalesce(total_issues_found, 0) AS total_issues_found,
           coalesce(streak_days, 0) AS streak_days, coalesce(issues_fixed, 0) AS issues_fixed,
           coalesce(b, '[]') AS badges, coalesce(rr, '[]') AS recent_reviews
    FROM v_users u LEFT JOIN scores x ON x.author_id = u.user_id
    LEFT JOIN totals t ON t.author_id = u.user_id
    LEFT JOIN review_streaks s ON s.user_id = u.user_id
    LEFT JOIN fixed f ON f.author_id = u.user_id
    LEFT JOIN badge_lists bl ON bl.user_id = u.user_id
    LEFT JOIN recent_lists rl ON rl.author_id = u.user_id""", badge_lists=BADGE_LISTS, recent_lists="""
    SELECT author_id, to_json(list(struct_pack(review_id := d.review_id, title := title, status := status,
           quality_score := quality_score, total_issues := coalesce(n, 0),
           critical_issues := coalesce(critical, 0), error_issues := coalesce(error, 0),
           warning_issues := coalesce(warning, 0), info_issues := coalesce(info, 0),
           created_at := strftime(created_at, '%Y-%m-%dT%H:%M:%S')) ORDER BY place))::VARCHAR AS rr
    FROM (SELECT *, row_number() OVER (PARTITION BY author_id
              ORDER BY created_at DESC, review_id DESC) AS place FROM done) d
    LEFT JOIN (SELECT review_id, count(*) AS n, count(*) FILTER (severity = 'critical') AS critical,
                      count(*) FILTER (severity = 'error') AS error,
                      count(*) FILTER (severity = 'warning') AS warning,
                      count(*) FILTER (severity = 'info') AS info
               FROM v_issues GROUP BY review_id) i ON i.review_id = d.review_id
    WHERE place <= 5 GROUP BY author_id"""))
def user_profile(spark, folder):
    profiles = nested.user_profile(t.users(spark, folder), t.reviews(spark, folder),
                                   t.issues(spark, folder), t.toggles(spark, folder))
    return nested.as_json(profiles, "badges", "recent_reviews")


def _counts_json(names, label: str, keep_zero: bool) -> str:
    entries = []
    for x in names:
        text = f"""'{{"{label}":"{x}","count":' || coalesce({x}, 0) || '}}'"""
        entries.append(text if keep_zero else f"CASE WHEN {x} > 0 THEN {text} END")
    return f"'[' || concat_ws(',', {', '.join(entries)}) || ']'"


@query(s.with_ctes("v_users trend top held author_stats v_authored scores totals review_streaks", f"""
    SELECT u.user_id, to_json(struct_pack(
               username := username, full_name := full_name,
               quality_score := coalesce(quality_score, 0.0::DOUBLE),
               total_reviews := coalesce(x.total_reviews, 0), streak_days := coalesce(streak_days, 0),
               total_issues_found := coalesce(total_issues_found, 0)))::VARCHAR AS user,
           coalesce(q, '[]') AS quality_trend,
           {_counts_json(CATEGORIES, 'category', False)} AS issues_by_category,
           {_counts_json(SEVERITIES, 'severity', True)} AS issues_by_severity,
           coalesce(tr, '[]') AS top_rules, coalesce(b, '[]') AS badges,
           to_json(struct_pack(avg_quality := avg_quality,
                               total_lines_reviewed := total_lines_reviewed,
                               fixable_issues := fixable_issues,
                               total_reviews := a.total_reviews))::VARCHAR AS stats
    FROM v_users u JOIN author_stats a ON a.author_id = u.user_id
    LEFT JOIN scores s ON s.author_id = u.user_id LEFT JOIN totals x ON x.author_id = u.user_id
    LEFT JOIN review_streaks r ON r.user_id = u.user_id
    LEFT JOIN trends t ON t.author_id = u.user_id
    LEFT JOIN tops o ON o.author_id = u.user_id
    LEFT JOIN badge_lists bl ON bl.user_id = u.user_id
    LEFT JOIN counts_wide c ON c.author_id = u.user_id""", trends="""
    SELECT author_id, to_json(list(struct_pack(review_num := review_num, title := title,
           score := score, date := date) ORDER BY review_num))::VARCHAR AS q
    FROM trend GROUP BY author_id""", tops="""
    SELECT author_id, to_json(list(struct_pack(rule_id := rule_id, title := title, count := n,
           severity := severity) ORDER BY n DESC, rule_id))::VARCHAR AS tr
    FROM top GROUP BY author_id""", badge_lists=BADGE_LISTS, counts_wide="SELECT author_id, " + ", ".join(
        [f"count(*) FILTER (severity = '{x}') AS {x}" for x in SEVERITIES]
        + [f"count(*) FILTER (category = '{x}') AS {x}" for x in CATEGORIES])
    + " FROM v_authored GROUP BY author_id"))
def dashboard(spark, folder):
    boards = nested.dashboard(t.users(spark, folder), t.reviews(spark, folder),
                              t.issues(spark, folder), t.toggles(spark, folder))
    return nested.as_json(boards, "user", "quality_trend", "issues_by_category", "issues_by_severity",
                          "top_rules", "badges", "stats")


# Audits -----------------------------------------------------------------------------------------

@query(s.with_ctes("v_users v_reviews held", """
    SELECT 'users.username' AS "check", username AS value, count(*) AS n FROM v_users
    GROUP BY username HAVING count(*) > 1
    UNION ALL SELECT 'users.email', email, count(*) FROM v_users GROUP BY email HAVING count(*) > 1
    UNION ALL SELECT 'user_badges', user_id || '/' || badge_id, count(*) FROM held
    GROUP BY user_id, badge_id HAVING count(*) > 1
    UNION ALL SELECT 'issue numbers', l_orderkey || '/' || l_linenumber, count(*) FROM lineitem
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""))
def audit_unique(spark, folder):
    users = t.users(spark, folder)
    return audits.audit_unique({
        "users.username": (users, ["username"]), "users.email": (users, ["email"]),
        "user_badges": (_held(spark, folder), ["user_id", "badge_id"]),
        "issue numbers": (t.toggles(spark, folder), ["review_id", "issue_no"])})


@query(s.with_ctes("v_users v_reviews v_issues v_review_files v_suggestions v_repositories held badges done", """
    SELECT 'review author' AS edge, count(*) AS n_rows,
           count(*) FILTER (author_id NOT IN (SELECT user_id FROM v_users)) AS n_orphans
    FROM v_reviews
    UNION ALL SELECT 'review repository', count(*), count(*) FILTER (repository_id NOT IN (
        SELECT repository_id FROM v_repositories)) FROM v_reviews WHERE repository_id IS NOT NULL
    UNION ALL SELECT 'issue review', count(*), count(*) FILTER (review_id NOT IN (
        SELECT review_id FROM v_reviews)) FROM v_issues
    UNION ALL SELECT 'issue complete review', count(*), count(*) FILTER (review_id NOT IN (
        SELECT review_id FROM done)) FROM v_issues
    UNION ALL SELECT 'repository owner', count(*), count(*) FILTER (owner_id NOT IN (
        SELECT user_id FROM v_users)) FROM v_repositories
    UNION ALL SELECT 'badge holder', count(*), count(*) FILTER (user_id NOT IN (
        SELECT user_id FROM v_users)) FROM held
    UNION ALL SELECT 'file review', count(*), count(*) FILTER (review_id NOT IN (
        SELECT review_id FROM done)) FROM v_review_files
    UNION ALL SELECT 'issue file', count(*), count(*) FILTER (review_id || '/' || file_no NOT IN (
        SELECT file_key FROM v_review_files)) FROM v_issues
    UNION ALL SELECT 'suggestion issue', count(*), count(*) FILTER (issue_id NOT IN (
        SELECT issue_id FROM v_issues)) FROM v_suggestions
    UNION ALL SELECT 'held badge', count(*), count(*) FILTER (badge_id NOT IN (
        SELECT badge_id FROM badges)) FROM held
    UNION ALL SELECT 'label document', count(*), count(*) FILTER (doc_id NOT IN (
        SELECT doc_id FROM documents)) FROM labels"""))
def audit_fk(spark, folder):
    users, reviews = t.users(spark, folder), t.reviews(spark, folder)
    issues, repositories = t.issues(spark, folder), t.repositories(spark, folder)
    held, files = _held(spark, folder), t.review_files(spark, folder)
    return audits.audit_references({
        "review author": (reviews, "author_id", users, "user_id"),
        "review repository": (reviews, "repository_id", repositories, "repository_id"),
        "issue review": (issues, "review_id", reviews, "review_id"),
        "issue complete review": (issues, "review_id", rollups.complete(reviews), "review_id"),
        "repository owner": (repositories, "owner_id", users, "user_id"),
        "badge holder": (held, "user_id", users, "user_id"),
        "held badge": (held, "badge_id", badges_frame(spark), "badge_id"),
        "file review": (files, "review_id", rollups.complete(reviews), "review_id"),
        "issue file": (issues.withColumn("file_key", t.file_key()), "file_key", files, "file_key"),
        "suggestion issue": (t.issue_suggestions(spark, folder), "issue_id", issues, "issue_id"),
        "label document": (t.table(spark, folder, "labels"), "doc_id",
                           t.table(spark, folder, "documents"), "doc_id")})


def _domain_sql(name: str, table: str, column: str, domain) -> str:
    return (f"SELECT '{name}' AS \"check\", {column} AS value, count(*) AS n,"
            f" {column} IN ({', '.join(map(s.quote, domain))}) AS ok FROM {table} GROUP BY {column}")


@query(s.with_ctes("v_reviews v_issues v_language", " UNION ALL ".join((
    _domain_sql("review status", "v_reviews", "status", STATUSES),
    _domain_sql("issue severity", "v_issues", "severity", SEVERITIES),
    _domain_sql("issue category", "v_issues", "category", CATEGORIES),
    _domain_sql("file extension", "v_language", "ext", LANGUAGES)))))
def audit_domain(spark, folder):
    files = t.files(spark, folder).select(extension(F.col("filename")).alias("ext"))
    issues = t.issues(spark, folder)
    return audits.audit_domains({
        "review status": (t.reviews(spark, folder), "status", STATUSES),
        "issue severity": (issues, "severity", SEVERITIES),
        "issue category": (issues, "category", CATEGORIES),
        "file extension": (files, "ext", LANGUAGES)})


TEXT_LIMITS = {
    "users": {"username": 50, "email": 120, "full_name": 100},
    "reviews": {"title": 300}, "issues": {"rule_id": 100, "title": 300},
    "files": {"filename": 500},
}


@query(s.with_ctes("v_users v_reviews v_issues v_files", " UNION ALL ".join(
    f"SELECT '{table}.{column}' AS \"check\", count(*) FILTER ({column} IS NULL) AS n_null,"
    f" count(*) FILTER (length({column}) > {limit}) AS n_too_long FROM v_{table}"
    for table, limits in TEXT_LIMITS.items() for column, limit in limits.items())))
def audit_nulls(spark, folder):
    read = {"users": t.users, "reviews": t.reviews, "issues": t.issues, "files": t.files}
    return audits.audit_texts({
        name: (read[name](spark, folder), limits) for name, limits in TEXT_LIMITS.items()})


# Changes ----------------------------------------------------------------------------------------

@query(s.with_ctes("acks", "SELECT * FROM acks"))
def ack_state(spark, folder):
    return changes.acknowledged(t.toggles(spark, folder))


@query(s.with_ctes("v_reviews v_issues v_review_files v_suggestions", """
    SELECT 'issue' AS child, issue_id AS key FROM v_issues WHERE review_id NOT IN (SELECT * FROM deleted)
    UNION ALL SELECT 'file', file_key FROM v_review_files WHERE review_id NOT IN (SELECT * FROM deleted)
    UNION ALL SELECT 'suggestion', issue_id FROM v_suggestions WHERE issue_id NOT IN (
        SELECT issue_id FROM v_issues WHERE review_id IN (SELECT * FROM deleted))""",
    deleted="SELECT review_id FROM v_reviews WHERE status = 'failed'"))
def cascade_delete(spark, folder):
    """Files, issues and suggestions left once the failed reviews are deleted."""
    deleted = t.reviews(spark, folder).filter(F.col("status") == "failed")
    left = changes.cascade_review(deleted, t.review_files(spark, folder), t.issues(spark, folder),
                                  t.issue_suggestions(spark, folder))
    keys = {"file": "file_key", "issue": "issue_id", "suggestion": "issue_id"}
    return reduce(DataFrame.union, [df.select(F.lit(name).alias("child"), F.col(keys[name]).alias("key"))
                                    for name, df in left.items()])


@query(s.with_ctes("full_findings", """
    SELECT file_id, rule_id, line_start, 'Auto-fix: ' || title AS title,
           fix_description AS explanation, 0.9::DOUBLE AS confidence
    FROM full_findings WHERE fix_description IS NOT NULL"""))
def suggestions(spark, folder):
    return changes.suggestions(findings_of.all_findings(t.files(spark, folder)))


@query(f"""
    SELECT o_orderkey AS review_id, CASE
               WHEN o_orderdate::DATE + 8 <= DATE '{STATUS_DAY}'
                   THEN CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'complete' END
               WHEN o_orderdate::DATE + 1 <= DATE '{STATUS_DAY}' THEN 'analyzing'
               ELSE 'pending' END AS status
    FROM orders WHERE o_orderdate::DATE <= DATE '{STATUS_DAY}'""")
def latest_status(spark, folder):
    return changes.latest_status(t.status_events(spark, folder), F.lit(STATUS_DAY).cast("date"))


# States as of a time ----------------------------------------------------------------------------

EVENTS_SQL = """
    SELECT o_orderkey AS review_id, status, (o_orderdate::DATE + days)::TIMESTAMP AS at
    FROM orders, (VALUES ('pending', 0), ('analyzing', 1), ('', 8)) steps(step, days),
         LATERAL (SELECT CASE WHEN step <> '' THEN step WHEN o_orderstatus = 'P' THEN 'failed'
                         ELSE 'complete' END AS status)"""
CLICKS_SQL = "SELECT l_orderkey AS review_id, l_linenumber::BIGINT AS issue_no, l_shipdate AS at FROM lineitem"


def _status_changes(spark, folder):
    return _timed(t.status_events(spark, folder))


def _timed(steps: DataFrame) -> DataFrame:
    return steps.select("review_id", "status", F.col("day").cast("timestamp_ntz").alias("at"))


@query(s.with_ctes("status_changes", """
    SELECT review_id, status, s.at, lead(s.at) OVER (PARTITION BY review_id ORDER BY s.at) AS valid_until
    FROM status_changes s""", status_changes=EVENTS_SQL))
def status_intervals(spark, folder):
    """From when until when each review had each status."""
    return asof.intervals(_status_changes(spark, folder), ["review_id"], "at", ["status"])


@query(s.with_ctes("status_changes clicks", """
    SELECT c.review_id, c.issue_no, c.at, s.status
    FROM clicks c ASOF LEFT JOIN status_changes s ON c.review_id = s.review_id AND c.at >= s.at""",
    status_changes=EVENTS_SQL, clicks=CLICKS_SQL))
def status_as_of(spark, folder):
    """The status that each review had when one of its issues was clicked."""
    return asof.as_of(t.clicks(spark, folder), _status_changes(spark, folder), ["review_id"], "at", ["status"])


@query(s.with_ctes("status_changes clicks", """
    SELECT s.review_id, i.issue_no, s.at, s.status, (SELECT count(*) FROM clicks c
        WHERE c.review_id = s.review_id AND c.issue_no = i.issue_no AND c.at <= s.at) % 2 = 1 AS is_acknowledged
    FROM status_changes s JOIN (SELECT DISTINCT review_id, issue_no FROM clicks) i ON s.review_id = i.review_id""",
    status_changes=EVENTS_SQL, clicks=CLICKS_SQL))
def acknowledged_as_of(spark, folder):
    """Whether each issue was acknowledged when its review changed its status.

    Reviews with few rows are dealt by review once, orders before they are made events and clicks for both
    uses; what is hot takes the shuffles of operators that cut a key.
    """
    issue, named = ["review_id", "issue_no"], "review_id is not null"
    parts = running.by_key_size("review_id", t.begun_reviews(spark, folder).filter(named),
                                t.clicks(spark, folder).filter(named))
    states = []
    for few, (begun, clicks) in parts:
        # An issue's first click, as it needs the time like the states, which a plain distinct would not.
        issues = running.first_rows(clicks, issue, ["at"], 1).select(*issue)
        asked = _timed(t.status_steps(begun)).join(issues, "review_id")
        states.append(asof.as_of(asked, changes.click_states(clicks, few), issue, "at", ["is_acknowledged"],
                                 ties=["turn"], few=few))
    return reduce(DataFrame.unionByName, states).fillna(False, ["is_acknowledged"])
