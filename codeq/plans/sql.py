"""SQL for checking: the canonical tables and shared steps as common table expressions.

Written for an engine with RE2 patterns, which know no look-around. Word boundaries are therefore
made visible first: ``words`` puts a mark before and after each run of word characters.
"""

from __future__ import annotations

import re

from codeq.operators.syntax import TEXTS
from codeq.rules.catalogue import BADGES, EXTENSION_LANGUAGE, PATTERN_RULES, SEVERITIES, PatternRule
from codeq.sources.snippets import SNIPPETS

SPACE = (r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
         r"\x{202f}\x{205f}\x{3000}")
WORD = r"\p{L}\p{N}_"
BREAK = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"

MARK = "chr(57344)"
OPEN, CLOSE, DOT = "\ue010", "\ue011", "\ue012"


def quote(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + value.replace("'", "''") + "'"


def values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(quote, row)) + ")" for row in rows)


CLASSES = {r"\s": f"[{SPACE}]", r"\S": f"[^{SPACE}]", r"\w": f"[{WORD}]", r"\W": f"[^{WORD}]",
           r"\d": r"\p{Nd}", r"\D": r"\P{Nd}"}


def re2(rule: PatternRule) -> str:
    """For rules without shorthands in classes; pairs of characters, so ``\\\\s`` keeps its meaning."""
    return "(?im)" + re.sub(r"\\.", lambda m: CLASSES.get(m[0], m[0]), rule.pattern)


def rules_sql(rules: tuple[PatternRule, ...]) -> str:
    return "SELECT * FROM (" + values(
        (i, r.rule_id, r.category, r.severity, r.title, r.message, r.fixable, r.fix, re2(r))
        for i, r in enumerate(rules)) + (
        ") t(idx, rule_id, category, severity, title, message, is_fixable, fix_description, pattern)")


def round_exact(column: str, digits: int, ties: str = "even") -> str:
    """Round a column >= 0 from its exact binary value."""
    scale, top, half = 10**digits, 2**52, 2**51
    whole = f"floor({column})::BIGINT"
    bits = f"(({column} - floor({column})) * {top}::DOUBLE)"
    high = f"floor({bits})::BIGINT"
    scaled = f"({high} * {scale})"
    excess = (f"(({scaled} % {top}) - {half})::DOUBLE"
              f" + ({bits} - floor({bits})) * {scale}")
    units = f"({whole} * {scale} + {scaled} // {top})"
    on_tie = f"{units} % 2 = 1" if ties == "even" else "true"
    return (f"(({units} + CASE WHEN {excess} > 0 OR ({excess} = 0 AND {on_tie}) THEN 1 ELSE 0 END)"
            f" / {scale}.0::DOUBLE)")


def filled(text: str | None, values: dict[str, str]) -> str | None:
    """A text of the syntax rules with its values."""
    for name, value in values.items():
        text = text and text.replace("{" + name + "}", value)
    return text


def band(column: str, bounds, other: str, sign: str = ">=") -> str:
    whens = " ".join(f"WHEN {column} {sign} {bound} THEN {quote(name)}" for bound, name in bounds)
    return f"CASE {whens} ELSE {quote(other)} END"


# What the syntax rules find in each snippet: (k, rule, severity, line). Worked out by hand.
SYNTAX_FINDINGS = (
    (3, "AST002", "info", 1), (3, "AST003", "error", 1), (3, "AST003", "error", 1),
    (4, "SYNTAX001", "critical", None),
    (6, "AST006", "warning", 1), (6, "AST007", "info", 1), (6, "AST001", "warning", 2),
    (6, "AST002", "info", 2),
    (8, "AST005", "warning", 1), (9, "AST004", "info", 1), (10, "AST004", "warning", 1),
    (11, "AST004", "info", 1), (11, "COMP001", "critical", None), (11, "COMP002", "warning", None),
)
# The same in the same order: text, values in it, line it ends on, snippet.
SYNTAX_DETAILS = (
    ("function_docstring", {"name": "add"}, None, None),
    ("mutable_default", {"name": "add"}, None, None), ("mutable_default", {"name": "add"}, None, None),
    ("syntax_error", {"name": ""}, None, None),
    ("class_name", {"name": "user_box", "better": "UserBox"}, None, None),
    ("class_docstring", {"name": "user_box"}, None, None),
    ("function_name", {"name": "getItem", "better": "get_item"}, None, "def getItem(...)"),
    ("function_docstring", {"name": "getItem"}, None, None),
    ("many_arguments", {"name": "wide", "n": "8"}, None, None),
    ("function_longish", {"name": "mid", "n": "34"}, None, None),
    ("function_long", {"name": "big", "n": "56"}, 57, None),
    ("function_longish", {"name": "deep", "n": "43"}, None, None),
    ("cyclomatic_critical", {"n": "22"}, None, None), ("cognitive", {"n": "21"}, None, None),
)
SYNTAX_CATEGORY = {
    "AST001": "style", "AST002": "documentation", "AST003": "bug", "AST004": "maintainability",
    "AST005": "maintainability", "AST006": "style", "AST007": "documentation",
    "COMP001": "complexity", "COMP002": "complexity", "SYNTAX001": "bug",
}
# Cyclomatic and cognitive complexity of the Python snippets 0-17.
COMPLEXITY = (
    (0, 1, 0), (1, 2, 1), (2, 1, 0), (3, 1, 0), (4, 0, 0), (5, 1, 0), (6, 1, 0), (7, 4, 6),
    (8, 1, 0), (9, 1, 0), (10, 1, 0), (11, 22, 21), (12, 4, 1), (13, 1, 0), (14, 1, 0),
    (15, 2, 1), (16, 4, 2), (17, 1, 0),
)
BROKEN = 4

_SEVERITY_RANKS = [(s, len(SEVERITIES) - i) for i, s in enumerate(SEVERITIES)]

# name -> (names it needs, text)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "snippets": ((), "SELECT * FROM (" + values(
        (k, ext, code) for k, (ext, code) in enumerate(SNIPPETS)) + ") t(k, ext, code)"),
    "v_files": (("snippets",), f"""
        SELECT doc_id AS file_id, source AS review_id, k, ext,
               'f' || doc_id || '.' || ext AS filename,
               CASE WHEN ext = 'py' THEN '# ' || replace(text, chr(10), chr(10) || '# ')
                    ELSE text END || chr(10) || code AS content,
               length(text) - length(replace(text, chr(10), '')) + 1 AS prose_lines
        FROM documents JOIN snippets ON k = doc_id % {len(SNIPPETS)}"""),
    "rules": ((), rules_sql(PATTERN_RULES)),
    "severities": ((), "SELECT * FROM (" + values(_SEVERITY_RANKS) + ") t(severity, severity_rank)"),
    "badges": ((), "SELECT * FROM (" + values(
        (i + 1, b["slug"], b["name"], b["description"], b["metric"], b["threshold"])
        for i, b in enumerate(BADGES))
        + ") t(badge_id, slug, name, description, metric, threshold)"),
    "languages": ((), "SELECT * FROM (" + values(EXTENSION_LANGUAGE.items())
                  + ") t(extension, language)"),
    "v_language": (("v_files", "languages"), r"""
        SELECT f.*, coalesce(language, 'unknown') AS language
        FROM v_files f LEFT JOIN languages ON extension = ext"""),
    # One row per match of a rule.
    "marked": (("v_files", "rules"), f"""
        SELECT file_id, review_id, rule_id, string_split(regexp_replace(
                   replace(content, {MARK}, chr(57345)), pattern, {MARK} || '\\0', 'g'),
                   chr(10)) AS pieces
        FROM v_files, rules WHERE regexp_matches(content, pattern)"""),
    "pieces": (("marked",), """
        SELECT file_id, review_id, rule_id, unnest(pieces) AS piece,
               generate_subscripts(pieces, 1) AS line_start
        FROM marked"""),
    "matches": (("pieces",), f"""
        SELECT file_id, review_id, rule_id, line_start,
               unnest(range(length(piece) - length(replace(piece, {MARK}, '')))) AS i
        FROM pieces WHERE contains(piece, {MARK})"""),
    "cut": (("v_language",), rf"""
        SELECT file_id, review_id, k, language,
               string_split_regex(content, '\r\n|[{BREAK}]') AS raw
        FROM v_language"""),
    "lines": (("cut",), """
        SELECT * EXCLUDE (raw), CASE WHEN raw[len(raw)] = '' THEN raw[1:len(raw) - 1] ELSE raw END
               AS lines
        FROM cut"""),
    "numbered": (("lines",), """
        SELECT file_id, review_id, k, language, unnest(lines) AS line,
               generate_subscripts(lines, 1) AS line_no
        FROM lines"""),
    "counts": (("lines",), rf"""
        SELECT file_id, review_id, k, language, len(lines) AS n_lines,
               len(list_filter(lines, lambda x: regexp_matches(x, '[^{SPACE}]'))) AS loc,
               len(list_filter(lines, lambda x: regexp_matches(x, '^[{SPACE}]*(?:#|//|/?\*)')))
                   AS comment_lines,
               len(list_filter(lines, lambda x: length(x) > 120)) AS long_lines
        FROM lines"""),
    "words": (("v_language",), rf"""
        SELECT file_id, k, language, regexp_replace(regexp_replace(content, '([{WORD}]+)',
                   '{OPEN}\1{CLOSE}', 'g'), '{CLOSE}\.{OPEN}', '{CLOSE}{DOT}{OPEN}', 'g') AS text
        FROM v_language"""),
    "tokens": (("words",), rf"""
        SELECT file_id, k, language,
               regexp_extract_all(text, '[+\-*/%&|^~<>]=?|==|!=|{OPEN}(?:and|or|not|in|is){CLOSE}')
                   AS operators,
               regexp_extract_all(text, '{OPEN}\p{{Nd}}+{CLOSE}{DOT}{OPEN}\p{{Nd}}+{CLOSE}'
                   || '|{OPEN}\p{{Nd}}+{CLOSE}{DOT}?|{OPEN}[a-zA-Z_][^{CLOSE}]*{CLOSE}') AS operands,
               len(regexp_extract_all(text,
                   '{OPEN}(?:if|else|elif|for|while|switch|case|catch){CLOSE}'))
               + len(regexp_extract_all(text, '{CLOSE}&&{OPEN}'))
               + len(regexp_extract_all(text, '{CLOSE}\|\|{OPEN}')) + 1 AS branches
        FROM words"""),
    "volumes": (("tokens",), """
        SELECT file_id, k, language, branches,
               len(operators) + len(operands) AS n_all,
               len(list_distinct(operators)) + len(list_distinct(operands)) AS n_distinct
        FROM tokens"""),
    "halstead": (("volumes",), """
        SELECT file_id, k, language, branches,
               CASE WHEN n_distinct < 2 THEN 0.0::DOUBLE
                    ELSE round(n_all * log2(n_distinct::DOUBLE), 2) END AS volume
        FROM volumes"""),
    "snippet_findings": ((), "SELECT * FROM (" + values(
        (k, rule, SYNTAX_CATEGORY[rule], severity, line)
        for k, rule, severity, line in SYNTAX_FINDINGS)
        + ") t(k, rule_id, category, severity, line)"),
    "snippet_complexity": ((), "SELECT * FROM (" + values(COMPLEXITY) + ") t(k, cc, cog)"),
    "complexity": (("halstead", "snippet_complexity"), """
        SELECT file_id, h.k, language, volume, coalesce(cc, branches)::DOUBLE AS cyclomatic,
               coalesce(cog, 0)::DOUBLE AS cognitive
        FROM halstead h LEFT JOIN snippet_complexity c ON h.k = c.k"""),
    "findings": (("matches", "rules", "snippet_findings", "v_files", "numbered"), f"""
        SELECT review_id, file_id, rule_id, category, severity, line_start
        FROM matches JOIN rules USING (rule_id)
        UNION ALL
        SELECT review_id, file_id, rule_id, category, severity, prose_lines + line
        FROM v_files JOIN snippet_findings USING (k)
        UNION ALL
        SELECT review_id, file_id, 'AST010', 'style', 'info', line_no FROM numbered
        WHERE language = 'python' AND k <> {BROKEN} AND length(line) > 120"""),
    "snippet_details": ((), "SELECT * FROM (" + values(
        (k, rule, SYNTAX_CATEGORY[rule], severity, line, end, snippet,
         *(filled(part, own) for part in TEXTS[text]))
        for (k, rule, severity, line), (text, own, end, snippet) in zip(
            SYNTAX_FINDINGS, SYNTAX_DETAILS, strict=True))
        + ") t(k, rule_id, category, severity, line, end_line, code_snippet, title, message,"
          " fix_description)"),
    # Findings with all their fields, but for the line and the message of a syntax error, which
    # depend on the parser's version.
    "full_findings": (("matches", "rules", "lines", "snippet_details", "v_files", "numbered"), rf"""
        SELECT m.review_id, m.file_id, rule_id, category, severity, title, message,
               line_start::INTEGER AS line_start, NULL::INTEGER AS line_end,
               CASE WHEN line_start <= len(lines) THEN substring(regexp_replace(
                   lines[line_start], '^[{SPACE}]+|[{SPACE}]+$', '', 'g'), 1, 200) ELSE '' END
                   AS code_snippet, is_fixable, fix_description
        FROM matches m JOIN rules USING (rule_id) JOIN lines l ON m.file_id = l.file_id
        UNION ALL
        SELECT review_id, file_id, rule_id, category, severity, title,
               CASE WHEN rule_id <> 'SYNTAX001' THEN message END,
               (prose_lines + line)::INTEGER, (prose_lines + end_line)::INTEGER, code_snippet,
               fix_description IS NOT NULL, fix_description
        FROM v_files JOIN snippet_details USING (k)
        UNION ALL
        SELECT review_id, file_id, 'AST010', 'style', 'info', {quote(TEXTS["long_line"][0])},
               replace(replace({quote(TEXTS["long_line"][1])}, '{{line}}', line_no::VARCHAR),
                       '{{n}}', length(line)::VARCHAR),
               line_no::INTEGER, NULL, substring(line, 1, 80) || '...', false, NULL
        FROM numbered WHERE language = 'python' AND k <> {BROKEN} AND length(line) > 120"""),
    "severity_by_file": (("findings",), """
        SELECT file_id, count(*) AS n,
               count(*) FILTER (severity = 'critical') AS critical,
               count(*) FILTER (severity = 'error') AS error,
               count(*) FILTER (severity = 'warning') AS warning,
               count(*) FILTER (severity = 'info') AS info
        FROM findings GROUP BY file_id"""),
    "indexed": (("counts", "complexity"), """
        SELECT c.file_id, review_id, c.language, c.k, loc, n_lines, comment_lines, volume, cyclomatic,
               cognitive, comment_lines / greatest(loc, 1) AS ratio
        FROM counts c JOIN complexity x ON c.file_id = x.file_id"""),
    "mi": (("indexed",), """
        SELECT *, CASE WHEN loc < 1 THEN 100.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(100.0::DOUBLE,
               round(171 - 5.2::DOUBLE * ln(greatest(volume, 1.0::DOUBLE))
                     - 0.23::DOUBLE * cyclomatic
                     - 16.2::DOUBLE * ln(greatest(loc, 1)::DOUBLE)
                     + 50 * sin(sqrt(2.4::DOUBLE * ratio)), 1))) END AS maintainability
        FROM indexed"""),
    "file_metrics": (("mi", "severity_by_file", "v_files"), """
        SELECT m.file_id, m.review_id, filename, language, loc, n_lines - loc AS blank_lines,
               comment_lines, cyclomatic, cognitive, volume AS halstead, maintainability,
               coalesce(n, 0) AS issue_count, coalesce(critical, 0) AS critical_issues,
               coalesce(error, 0) AS error_issues, coalesce(warning, 0) AS warning_issues,
               coalesce(info, 0) AS info_issues,
               greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE
                   - coalesce(critical, 0) * 15 - coalesce(error, 0) * 8
                   - coalesce(warning, 0) * 3 - coalesce(info, 0) * 0.5::DOUBLE
                   - CASE WHEN cyclomatic > 20 THEN 15 WHEN cyclomatic > 10 THEN 8
                          WHEN cyclomatic > 7 THEN 3 ELSE 0 END
                   + CASE WHEN maintainability > 80 THEN 5 WHEN maintainability < 40 THEN -10
                          ELSE 0 END)) AS quality_score
        FROM mi m JOIN v_files f ON m.file_id = f.file_id
        LEFT JOIN severity_by_file s ON m.file_id = s.file_id"""),
    "code_lines": (("numbered",), rf"""
        SELECT review_id, file_id, stripped FROM (
            SELECT review_id, file_id,
                   regexp_replace(line, '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS stripped
            FROM numbered)
        WHERE length(stripped) > 10 AND NOT starts_with(stripped, '#')"""),
    "line_groups": (("code_lines",), """
        SELECT review_id, stripped, count(*) AS n FROM code_lines GROUP BY ALL"""),
    "dup_raw": (("line_groups", "v_files"), """
        SELECT r.review_id, coalesce(sum(n), 0)::BIGINT AS n_lines,
               coalesce(sum(n - 1), 0)::BIGINT AS n_duplicated,
               coalesce(sum(n - 1), 0)::DOUBLE / greatest(coalesce(sum(n), 0), 1) * 100 AS pct
        FROM (SELECT DISTINCT review_id FROM v_files) r
        LEFT JOIN line_groups g ON r.review_id = g.review_id GROUP BY r.review_id"""),
    "dup": (("dup_raw",), f"""
        SELECT review_id, n_lines, n_duplicated, {round_exact('pct', 1)} AS duplication_pct
        FROM dup_raw"""),
    "review_sums": (("file_metrics",), """
        SELECT review_id, count(*) AS total_files, sum(loc)::BIGINT AS total_lines,
               sum(issue_count)::BIGINT AS total_issues,
               sum(critical_issues)::BIGINT AS critical_issues,
               sum(error_issues)::BIGINT AS error_issues,
               sum(warning_issues)::BIGINT AS warning_issues,
               sum(info_issues)::BIGINT AS info_issues,
               sum(round(quality_score * 10)::BIGINT)::DOUBLE / 10 / count(*) AS q,
               sum(round(maintainability * 10)::BIGINT)::DOUBLE / 10 / count(*) AS mi,
               sum(cyclomatic::BIGINT)::DOUBLE / count(*) AS cc
        FROM file_metrics GROUP BY review_id"""),
    "review_metrics": (("review_sums", "dup"), f"""
        SELECT r.review_id, total_files, total_lines, total_issues, critical_issues, error_issues,
               warning_issues, info_issues, {round_exact('q', 1)} AS quality_score,
               {round_exact('mi', 1)} AS maintainability,
               {round_exact('cc', 2)} AS avg_complexity, duplication_pct
        FROM review_sums r JOIN dup d ON r.review_id = d.review_id"""),
    # The platform tables.
    "v_users": ((), """
        SELECT c_custkey AS user_id, c_name AS username,
               lower(c_mktsegment) || '.' || floor(c_acctbal)::BIGINT || '@example.com' AS email,
               upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:]) || ' ' || c_name AS full_name,
               c_acctbal >= 0 AS is_active
        FROM customer"""),
    "v_reviews": ((), """
        SELECT o_orderkey AS review_id, o_custkey AS author_id,
               CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey * 10 + o_orderkey % 3 END
                   AS repository_id,
               'Review ' || o_orderkey || ' with priority ' || o_orderpriority AS title,
               CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'analyzing'
                    ELSE 'failed' END AS status,
               (floor(o_totalprice)::BIGINT % 201) / 2.0::DOUBLE AS quality_score,
               floor(o_totalprice)::BIGINT % 1000 AS total_lines, o_orderdate AS created_at
        FROM orders"""),
    "done": (("v_reviews",), "SELECT * FROM v_reviews WHERE status = 'complete'"),
    "v_issues": (("rules",), f"""
        SELECT md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS issue_id,
               l_orderkey AS review_id, l_linenumber::BIGINT AS file_no, rule_id, category,
               severity, title, is_fixable,
               nullif(l_quantity::INTEGER, 50) AS line_start, l_returnflag = 'R' AS is_acknowledged
        FROM lineitem JOIN rules ON idx = l_partkey % {len(PATTERN_RULES)}"""),
    "v_authored": (("v_issues", "v_reviews"), """
        SELECT i.*, author_id, status FROM v_issues i JOIN v_reviews r ON i.review_id = r.review_id"""),
    "v_review_files": (("v_issues",), """
        SELECT DISTINCT review_id, file_no, review_id || '/' || file_no AS file_key
        FROM v_issues WHERE file_no <= 6"""),
    "v_suggestions": (("v_issues",), "SELECT issue_id FROM v_issues WHERE is_fixable"),
    "v_repositories": (("v_reviews",), """
        SELECT repository_id, min(author_id) AS owner_id, max(created_at) AS updated_at,
               'repo-' || repository_id AS name
        FROM v_reviews WHERE repository_id IS NOT NULL GROUP BY repository_id"""),
    "acks": ((), """
        SELECT l_orderkey AS review_id, l_linenumber::BIGINT AS issue_no,
               count(*) % 2 = 1 AS is_acknowledged
        FROM lineitem GROUP BY ALL"""),
    "fixed": (("acks", "v_reviews"), """
        SELECT author_id, count(*) AS issues_fixed FROM acks JOIN v_reviews USING (review_id)
        WHERE is_acknowledged GROUP BY author_id"""),
    "review_days": (("done",), """
        SELECT DISTINCT author_id AS user_id, created_at::DATE AS day FROM done"""),
    "active_days": ((), "SELECT DISTINCT user_id, ts::DATE AS day FROM events"),
    "review_runs": (("review_days",), """
        SELECT user_id, count(*) AS n_days FROM (
            SELECT user_id, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INTEGER
                   AS run FROM review_days) GROUP BY user_id, run"""),
    "review_streaks": (("review_runs",), """
        SELECT user_id, max(n_days) AS streak_days FROM review_runs GROUP BY user_id"""),
    "active_runs": (("active_days",), """
        SELECT user_id, count(*) AS n_days, min(day) AS first_day, max(day) AS last_day FROM (
            SELECT user_id, day, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INTEGER
                   AS run FROM active_days) GROUP BY user_id, run"""),
    "author_metrics": (("done", "v_authored", "fixed", "review_streaks"), """
        SELECT d.author_id, reviews, best AS quality_score, first_at, last_at,
               coalesce(critical_found, 0) AS critical_found,
               coalesce(issues_fixed, 0) AS issues_fixed, coalesce(streak_days, 0) AS streak_days
        FROM (SELECT author_id, count(*) AS reviews, max(quality_score) AS best,
                     min(created_at) AS first_at, max(created_at) AS last_at
              FROM done GROUP BY author_id) d
        LEFT JOIN (SELECT author_id, count(*) AS critical_found FROM v_authored
                   WHERE severity = 'critical' GROUP BY author_id) c ON d.author_id = c.author_id
        LEFT JOIN fixed f ON d.author_id = f.author_id
        LEFT JOIN review_streaks s ON d.author_id = s.user_id"""),
    "held": (("author_metrics", "badges"), """
        SELECT author_id AS user_id, badge_id, slug, name, description,
               CASE WHEN slug = 'first-review' THEN first_at ELSE last_at END AS earned_at
        FROM author_metrics JOIN badges ON
             CASE metric WHEN 'reviews' THEN reviews WHEN 'critical_found' THEN critical_found
                  WHEN 'quality_score' THEN quality_score WHEN 'issues_fixed' THEN issues_fixed
                  ELSE streak_days END >= threshold"""),
    "totals": (("done", "v_issues"), """
        SELECT author_id, count(*) AS total_reviews,
               sum(coalesce(n, 0))::BIGINT AS total_issues_found
        FROM done d LEFT JOIN (SELECT review_id, count(*) AS n FROM v_issues GROUP BY review_id) i
             ON d.review_id = i.review_id
        GROUP BY author_id"""),
    "scores": (("done",), f"""
        SELECT author_id, list_reduce(
                   list(struct_pack(n := 1::BIGINT, q := quality_score)
                        ORDER BY created_at, review_id),
                   lambda a, x: struct_pack(n := a.n + 1, q := list_transform(
                       [(a.q * a.n + x.q) / (a.n + 1)], lambda v: {round_exact('v', 1)})[1])).q
               AS quality_score
        FROM done GROUP BY author_id"""),
    "trend": (("done",), """
        SELECT author_id, row_number() OVER (PARTITION BY author_id ORDER BY place DESC)
               AS review_num, review_id, title[1:30] AS title, quality_score AS score,
               strftime(created_at, '%b %d') AS date
        FROM (SELECT *, row_number() OVER (PARTITION BY author_id
                            ORDER BY created_at DESC, review_id DESC) AS place FROM done)
        WHERE place <= 10"""),
    "top": (("v_authored",), """
        SELECT author_id, rule_id, min(title) AS title, min(severity) AS severity, count(*) AS n
        FROM v_authored GROUP BY author_id, rule_id
        QUALIFY row_number() OVER (PARTITION BY author_id ORDER BY count(*) DESC, rule_id) <= 5"""),
    "means": (("v_users", "done", "v_authored"), """
        SELECT user_id AS author_id, coalesce(q, 0.0::DOUBLE) AS mean,
               coalesce(lines, 0) AS total_lines_reviewed, coalesce(fixable, 0) AS fixable_issues,
               coalesce(reviews, 0) AS total_reviews
        FROM v_users
        LEFT JOIN (SELECT author_id, avg(coalesce(quality_score, 0)) AS q, count(*) AS reviews,
                          sum(total_lines)::BIGINT AS lines FROM done GROUP BY author_id) d
             ON d.author_id = user_id
        LEFT JOIN (SELECT author_id, count(*) FILTER (is_fixable) AS fixable FROM v_authored
                   GROUP BY author_id) i ON i.author_id = user_id"""),
    "author_stats": (("means",), f"""
        SELECT author_id, {round_exact('mean', 1)} AS avg_quality, total_lines_reviewed,
               fixable_issues, total_reviews FROM means"""),
}


def with_ctes(needed: str, select: str, **own: str) -> str:
    """The select, preceded by the expressions it needs (names separated by blanks).

    ``own`` adds expressions after the shared ones, or replaces a shared one of the same name.
    """
    order: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in order:
            needs, text = ((), own[name]) if name in own else CTES[name]
            for other in needs:
                add(other)
            order[name] = text

    for name in [*needed.split(), *own]:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({text})" for n, text in order.items()) + "\n" + select
