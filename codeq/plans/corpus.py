"""Queries over the corpus of source files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeq.functions import metrics as m
from codeq.functions import naming
from codeq.functions import presentation as p
from codeq.operators import duplication as dup
from codeq.operators import findings as fnd
from codeq.operators import bindings, blocks, intake, packs, scan, syntax
from codeq.operators import metrics as met
from codeq.plans import sql as s
from codeq.plans.registry import query
from codeq.rules.catalogue import PATTERN_RULES, PatternRule
from codeq.sources import tables as t
from codeq.sources.sinks import read_back, write_findings

# Intake -----------------------------------------------------------------------------------------

@query(s.with_ctes("v_files", "SELECT file_id, review_id, filename, strlen(content) AS n_bytes,"
                              " md5(content) AS digest FROM v_files"))
def scan_files(spark, folder):
    return t.files(spark, folder).select(
        "file_id", "review_id", "filename",
        F.octet_length("content").cast("long").alias("n_bytes"),
        F.md5(F.col("content").cast("binary")).alias("digest"))


@query(r"""
    WITH latin AS (SELECT doc_id, regexp_replace(text, '[^\x00-\x{FF}]', '?', 'g') AS t, lang
                   FROM documents),
    judged AS (SELECT doc_id, lang = 'en' OR regexp_full_match(t,
        '(?s)(?:[\x00-\x7F]|[\x{C2}-\x{DF}][\x{80}-\x{BF}]'
        || '|\x{E0}[\x{A0}-\x{BF}][\x{80}-\x{BF}]'
        || '|[\x{E1}-\x{EC}\x{EE}\x{EF}][\x{80}-\x{BF}]{2}|\x{ED}[\x{80}-\x{9F}][\x{80}-\x{BF}]'
        || '|\x{F0}[\x{90}-\x{BF}][\x{80}-\x{BF}]{2}|[\x{F1}-\x{F3}][\x{80}-\x{BF}]{3}'
        || '|\x{F4}[\x{80}-\x{8F}][\x{80}-\x{BF}]{2})*') AS ok
        FROM latin)
    SELECT doc_id AS file_id, NOT ok AS is_rejected FROM judged""")
def reject_bad_utf8(spark, folder):
    """Documents as uploaded bytes: the English ones in UTF-8, the others in Latin-1."""
    latin = F.encode(F.regexp_replace("text", r"[^\x00-\xff]", "?"), "ISO-8859-1")
    uploads = t.table(spark, folder, "documents").select(
        F.col("doc_id").alias("file_id"),
        F.when(F.col("lang") == "en", F.col("text").cast("binary")).otherwise(latin).alias("bytes"))
    return intake.decode(uploads).select("file_id", "is_rejected")


@query(s.with_ctes("v_files", "SELECT file_id, strlen(content) AS n_bytes,"
                              " strlen(content) > 512000 AS is_oversize FROM v_files"))
def reject_oversize(spark, folder):
    return intake.check_size(t.files(spark, folder)).select("file_id", "n_bytes", "is_oversize")


@query(s.with_ctes("v_files", "SELECT review_id, count(*) AS n_files,"
                              " count(*) > 20 AS is_rejected FROM v_files GROUP BY review_id"))
def reject_too_many_files(spark, folder):
    return intake.check_file_count(t.files(spark, folder))


@query(s.with_ctes("v_files", "SELECT file_id, filename FROM v_files WHERE ext IN"
                              " ('py','js','ts','jsx','tsx','java','cpp','cc','c','h','go','rs')"))
def filter_accepted_ext(spark, folder):
    return intake.accepted(t.files(spark, folder)).select("file_id", "filename")


@query(s.with_ctes("numbered", "SELECT file_id, line_no, line FROM numbered"))
def explode_lines(spark, folder):
    return intake.explode_lines(t.files(spark, folder))


UPLOADS = """
    SELECT conv_id AS review_id, role || '.py' AS filename, turn AS upload_seq,
           strlen(text) AS n_bytes FROM conversations"""


def _uploads(spark, folder) -> DataFrame:
    """Conversation turns as uploads: a role's later turn overwrites its earlier ones."""
    return t.table(spark, folder, "conversations").select(
        F.col("conv_id").alias("review_id"), F.concat("role", F.lit(".py")).alias("filename"),
        F.col("turn").alias("upload_seq"), F.octet_length("text").cast("long").alias("n_bytes"))


@query(f"""
    SELECT review_id, filename, upload_seq, n_bytes FROM ({UPLOADS}) u
    QUALIFY row_number() OVER (PARTITION BY review_id, filename
                               ORDER BY upload_seq DESC, n_bytes DESC) = 1""")
def dedupe_last_upload(spark, folder):
    return intake.last_upload(_uploads(spark, folder))


@query(f"""
    WITH firsts AS (SELECT review_id, filename, min(upload_seq) AS upload_seq
                    FROM ({UPLOADS}) u GROUP BY ALL)
    SELECT review_id, filename, upload_seq FROM firsts
    QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY upload_seq, filename) <= 20""")
def dedupe_first_cap(spark, folder):
    return intake.first_uploads(_uploads(spark, folder))


@query(s.with_ctes("full_findings", "SELECT * FROM full_findings"))
def sink_findings(spark, folder):
    """The findings as written, one folder per severity, and read back."""
    return comparable(read_back(spark, write_findings(fnd.all_findings(t.files(spark, folder)))))


# Pattern rules ----------------------------------------------------------------------------------

@query(s.with_ctes("matches", "SELECT review_id, file_id, rule_id, line_start FROM matches"))
def rule_scan(spark, folder):
    return scan.scan_rules(t.files(spark, folder))


@query(s.with_ctes("matches rules", """
    SELECT r.rule_id, count(m.file_id) AS n_matches
    FROM rules r LEFT JOIN matches m ON m.rule_id = r.rule_id GROUP BY r.rule_id"""))
def rule_counts(spark, folder):
    return scan.count_rules(t.files(spark, folder))


@query(s.with_ctes("matches", """
    SELECT CASE WHEN starts_with(rule_id, 'SEC') THEN 'security'
                WHEN starts_with(rule_id, 'PERF') THEN 'performance'
                WHEN starts_with(rule_id, 'STYLE') THEN 'style' ELSE 'maintainability' END
           AS category, count(*) AS n FROM matches GROUP BY 1"""))
def rule_category(spark, folder):
    found = scan.scan_rules(t.files(spark, folder))
    return found.select(scan.category_of(F.col("rule_id")).alias("category")).groupBy(
        "category").agg(F.count("*").alias("n"))


@query(s.with_ctes("matches lines", rf"""
    SELECT m.file_id, rule_id, line_start, CASE WHEN line_start <= len(lines) THEN
               substring(regexp_replace(lines[line_start], '^[{s.SPACE}]+|[{s.SPACE}]+$', '', 'g'),
                         1, 200) ELSE '' END AS code_snippet
    FROM matches m JOIN lines l ON m.file_id = l.file_id"""))
def rule_snippet(spark, folder):
    return scan.scan_rules(t.files(spark, folder), snippets=True).drop("review_id")


@query(s.with_ctes("matches rules", """
    SELECT review_id, file_id, rule_id, line_start, severity, category, title, message, is_fixable,
           fix_description FROM matches JOIN rules USING (rule_id)"""))
def findings_enriched(spark, folder):
    return scan.enrich(scan.scan_rules(t.files(spark, folder)))


CUSTOM_RULES = (
    PatternRule("TEAM001", "warning", r"\breturn\s+\w+", "Return of a plain name",
                needles=("return",)),
    PatternRule("TEAM002", "info", r"^\s*import\s", "Import", needles=("import",)),
    PatternRule("TEAM003", "info", r"(\w+)ing\b", "Word in -ing"),
    PatternRule("TEAM004", "critical", r"\d\d+\W\S", "Number before a sign"),
    PatternRule("TEAM005", "error", r"\D{3}\\s|\S+é\S*\W\s*\w", "Backslash, or a word with an accent"),
)


@query(s.with_ctes("matches", "SELECT file_id, rule_id, line_start FROM matches",
                   rules=s.rules_sql(CUSTOM_RULES)))
def custom_rules(spark, folder):
    return scan.scan_rules(t.files(spark, folder), CUSTOM_RULES).drop("review_id")


@query(s.with_ctes("file_metrics", "SELECT file_id, issue_count, critical_issues, error_issues, quality_score"
                   " FROM file_metrics", rules=s.rules_sql((*PATTERN_RULES, *CUSTOM_RULES))))
def custom_file_metrics(spark, folder):
    """Counts and scores with the own rules beside the built-in ones."""
    return met.file_metrics(t.files(spark, folder), (*PATTERN_RULES, *CUSTOM_RULES)).select(
        "file_id", "issue_count", "critical_issues", "error_issues", "quality_score")


# A pack of 294 rules: words that begin with three letters and end in s or e, and the rules above.
RULE_PACK = (*PATTERN_RULES, *CUSTOM_RULES, *(
    PatternRule(f"WORD-{a}{b}{c}", "info", f"{a}{b}{c}[a-z]+[es] ", "Word", needles=(a + b + c,))
    for a in "abcdefghijklmnopqrstuvwxyz" for b in "aeiou" for c in "nr"))


@query(s.with_ctes("matches", "SELECT file_id, rule_id, line_start FROM matches", rules=s.rules_sql(RULE_PACK)))
def rule_pack(spark, folder):
    return packs.scan_pack(t.files(spark, folder), RULE_PACK).drop("review_id")


@query(s.with_ctes("matches", "SELECT rule_id, count(*) AS n_matches FROM matches GROUP BY rule_id",
                   rules=s.rules_sql(RULE_PACK)))
def rule_pack_counts(spark, folder):
    return packs.count_pack(t.files(spark, folder), RULE_PACK)


# File metrics -----------------------------------------------------------------------------------

@query(s.with_ctes("v_language", "SELECT file_id, filename, language FROM v_language"))
def detect_language(spark, folder):
    return t.files(spark, folder).select("file_id", "filename",
                                         m.language(F.col("filename")).alias("language"))


@query(s.with_ctes("counts", "SELECT file_id, loc, n_lines - loc AS blank_lines, comment_lines"
                             " FROM counts"))
def line_counts(spark, folder):
    return met.line_counts(t.files(spark, folder))


@query(s.with_ctes("counts", "SELECT file_id, comment_lines / greatest(loc, 1) AS comment_ratio"
                             " FROM counts"))
def comment_ratio(spark, folder):
    return met.line_counts(t.files(spark, folder)).select(
        "file_id", m.comment_ratio(F.col("comment_lines"), F.col("loc")).alias("comment_ratio"))


@query(s.with_ctes("tokens", "SELECT file_id, branches::DOUBLE AS complexity FROM tokens"
                             " WHERE language <> 'python'"))
def heuristic_complexity(spark, folder):
    others = t.files(spark, folder).filter(m.language(F.col("filename")) != "python")
    return others.select("file_id", m.branch_complexity(F.col("content")).alias("complexity"))


@query(s.with_ctes("halstead", "SELECT file_id, volume FROM halstead"))
def halstead(spark, folder):
    return met.halstead(t.files(spark, folder))


@query(s.with_ctes("file_metrics", "SELECT file_id, maintainability FROM file_metrics"))
def maintainability_index(spark, folder):
    return met.file_metrics(t.files(spark, folder)).select("file_id", "maintainability")


@query(s.with_ctes("file_metrics", "SELECT file_id, quality_score FROM file_metrics"))
def file_quality(spark, folder):
    return met.file_metrics(t.files(spark, folder)).select("file_id", "quality_score")


FILE_METRICS = (
    "file_id", "review_id", "filename", "language", "loc", "blank_lines", "comment_lines",
    "cyclomatic", "cognitive", "halstead", "maintainability", "issue_count", "critical_issues",
    "error_issues", "warning_issues", "info_issues", "quality_score")


@query(s.with_ctes("file_metrics", f"SELECT {', '.join(FILE_METRICS)} FROM file_metrics"))
def file_metrics(spark, folder):
    return met.file_metrics(t.files(spark, folder)).select(*FILE_METRICS)


TITLES = s.values((
    ("AST001", "warning", "Function name not snake_case"),
    ("AST002", "info", "Missing docstring"),
    ("AST003", "error", "Mutable default argument"),
    ("AST004", "warning", "Function too long"),
    ("AST004", "info", "Function somewhat long"),
    ("AST005", "warning", "Too many function arguments"),
    ("AST006", "warning", "Class name not PascalCase"),
    ("AST007", "info", "Missing class docstring"),
    ("AST010", "info", "Line too long"),
))


@query(s.with_ctes("findings rules", """
    SELECT file_id, line_start::VARCHAR AS line, string_agg(label, ' | ' ORDER BY label) AS labels
    FROM titled GROUP BY ALL""", titled=f"""
    SELECT f.file_id, line_start, '[' || upper(f.severity) || '] ' || coalesce(r.title, x.title)
           AS label
    FROM findings f LEFT JOIN rules r ON f.rule_id = r.rule_id
    LEFT JOIN ({TITLES}) x(rule_id, severity, title)
         ON f.rule_id = x.rule_id AND f.severity = x.severity
    WHERE line_start IS NOT NULL"""))
def annotations(spark, folder):
    """The annotation map of each file, one row per entry; broken files are not comparable.

    The line of a syntax error depends on the parser version, so its label is left out.
    """
    noted = fnd.annotations(fnd.all_findings(t.files(spark, folder))).select(
        "file_id", F.explode("annotations").alias("line", "labels"))
    kept = noted.withColumn("labels", F.filter("labels", lambda x: x != "[CRITICAL] Syntax Error"))
    return kept.filter(F.size("labels") > 0).withColumn("labels", F.array_join("labels", " | "))


# Syntax -----------------------------------------------------------------------------------------

@query(s.with_ctes("v_files", """
    SELECT kind, sum(per_file)::BIGINT AS n FROM v_files JOIN (VALUES
        (1, 'except', 1), (3, 'function', 1), (4, 'syntax_error', 1), (5, 'function', 1),
        (6, 'class', 1), (6, 'function', 1), (7, 'function', 1), (7, 'if', 3),
        (8, 'function', 1), (9, 'function', 1), (10, 'function', 1), (11, 'function', 1),
        (11, 'if', 21), (12, 'function', 1), (12, 'if', 1), (12, 'boolop', 1),
        (15, 'function', 1), (15, 'for', 1), (16, 'except', 1), (16, 'if', 1),
        (16, 'boolop', 1), (17, 'function', 1)) x(k, kind, per_file) USING (k)
    GROUP BY kind"""))
def syntax_facts(spark, folder):
    return syntax.facts_table(t.files(spark, folder)).groupBy("kind").agg(F.count("*").alias("n"))


STRUCTURE_FIELDS = ("review_id", "file_id", "rule_id", "line_start", "line_end", "severity", "title",
                    "message", "code_snippet", "fix_description")


def comparable(found: DataFrame) -> DataFrame:
    """Findings without the line and message of a syntax error, which depend on the parser's version."""
    known = F.col("rule_id") != "SYNTAX001"
    return found.withColumns({c: F.when(known, F.col(c)) for c in ("line_start", "message")})


def _structure(spark, folder, rule_id: str) -> DataFrame:
    found = syntax.explode_findings(
        t.files(spark, folder), syntax.structure_findings())
    return comparable(found.filter(F.col("rule_id") == rule_id)).select(*STRUCTURE_FIELDS)


def _structure_sql(rule_id: str) -> str:
    return s.with_ctes("full_findings", f"""
        SELECT {', '.join(STRUCTURE_FIELDS)} FROM full_findings WHERE rule_id = '{rule_id}'""")


@query(_structure_sql("SYNTAX001"))
def syntax_errors(spark, folder):
    return _structure(spark, folder, "SYNTAX001")


@query(_structure_sql("AST001"))
def ast_function_naming(spark, folder):
    return _structure(spark, folder, "AST001")


@query(_structure_sql("AST002"))
def ast_function_docstring(spark, folder):
    return _structure(spark, folder, "AST002")


@query(_structure_sql("AST003"))
def ast_mutable_default(spark, folder):
    return _structure(spark, folder, "AST003")


@query(_structure_sql("AST004"))
def ast_long_function(spark, folder):
    return _structure(spark, folder, "AST004")


@query(_structure_sql("AST005"))
def ast_too_many_args(spark, folder):
    return _structure(spark, folder, "AST005")


@query(_structure_sql("AST006"))
def ast_class_naming(spark, folder):
    return _structure(spark, folder, "AST006")


@query(_structure_sql("AST007"))
def ast_class_docstring(spark, folder):
    return _structure(spark, folder, "AST007")


@query(s.with_ctes("full_findings", """
    SELECT file_id, line_start, code_snippet, message FROM full_findings WHERE rule_id = 'AST010'"""))
def long_lines(spark, folder):
    found = syntax.explode_findings(
        t.files(spark, folder),
        F.when(syntax.parsed(), syntax.long_line_findings()))
    return found.select("file_id", "line_start", "code_snippet", "message")


def _facts(spark, folder) -> DataFrame:
    return syntax.with_facts(t.files(spark, folder)).filter(F.col("language") == "python")


@query(s.with_ctes("v_files snippet_complexity", "SELECT file_id, cc::BIGINT AS cyclomatic"
                   " FROM v_files JOIN snippet_complexity USING (k)"))
def cyclomatic(spark, folder):
    return _facts(spark, folder).select("file_id", syntax.cyclomatic().alias("cyclomatic"))


@query(s.with_ctes("v_files snippet_complexity", "SELECT file_id, cog::BIGINT AS cognitive"
                   " FROM v_files JOIN snippet_complexity USING (k)"))
def cognitive(spark, folder):
    return _facts(spark, folder).select("file_id", syntax.cognitive().alias("cognitive"))


def _complexity(spark, folder, rule_id: str) -> DataFrame:
    found = syntax.explode_findings(
        t.files(spark, folder),
        F.when(syntax.parsed(), syntax.complexity_findings()))
    return found.filter(F.col("rule_id") == rule_id).select("file_id", "severity", "message")


@query(s.with_ctes("full_findings", """
    SELECT file_id, severity, message FROM full_findings WHERE rule_id = 'COMP001'"""))
def comp_cyclomatic(spark, folder):
    return _complexity(spark, folder, "COMP001")


@query(s.with_ctes("full_findings", """
    SELECT file_id, severity, message FROM full_findings WHERE rule_id = 'COMP002'"""))
def comp_cognitive(spark, folder):
    return _complexity(spark, folder, "COMP002")


# Snippet, name, line and number of uses of each import in the snippets, worked out by hand.
IMPORTS = """
    SELECT review_id, file_id, name, (prose_lines + line)::INTEGER AS line_start, n_uses::BIGINT AS n_uses
    FROM v_files JOIN (VALUES (13, 'subprocess', 1, 1), (13, 'os', 1, 1), (13, 'pickle', 1, 1),
        (13, 'hashlib', 1, 2), (13, 'random', 1, 1), (15, 'time', 1, 1)) x(k, name, line, n_uses) USING (k)"""


@query(s.with_ctes("v_files", IMPORTS))
def import_uses(spark, folder):
    return bindings.import_uses(bindings.name_facts(t.files(spark, folder)))


@query(s.with_ctes("v_files", f"SELECT review_id, file_id, name, line_start FROM ({IMPORTS}) WHERE n_uses = 0"))
def unused_imports(spark, folder):
    return bindings.unused_imports(bindings.name_facts(t.files(spark, folder)))


NAMES = """
    SELECT DISTINCT unnest(regexp_extract_all(content, '[a-zA-Z_][a-zA-Z0-9_]*')) AS name
    FROM v_files"""


def _names(spark, folder) -> DataFrame:
    found = t.files(spark, folder).select(F.explode(F.regexp_extract_all(
        "content", F.lit("[a-zA-Z_][a-zA-Z0-9_]*"), F.lit(0))).alias("name"))
    return found.distinct()


@query(s.with_ctes("v_files", r"""
    SELECT name, lower(regexp_replace(regexp_replace(name, '(.)([A-Z][a-z]+)', '\1_\2', 'g'),
                                      '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS better FROM names""", names=NAMES))
def to_snake(spark, folder):
    return _names(spark, folder).select("name", naming.to_snake("name").alias("better"))


@query(s.with_ctes("v_files", r"""
    SELECT name, replace(array_to_string(list_transform(
        regexp_extract_all(name, '\p{L}+|[^\p{L}]+'),
        lambda x: upper(x[1:1]) || lower(x[2:])), ''), '_', '') AS better FROM names""", names=NAMES))
def to_pascal(spark, folder):
    return _names(spark, folder).select("name", naming.to_pascal("name").alias("better"))


@query(s.with_ctes("full_findings", "SELECT * FROM full_findings"))
def all_findings(spark, folder):
    return comparable(fnd.all_findings(t.files(spark, folder)))


@query(s.with_ctes("v_files severity_by_file", """
    SELECT f.file_id, coalesce(n, 0) AS issue_count FROM v_files f
    LEFT JOIN severity_by_file s ON f.file_id = s.file_id"""))
def issue_count(spark, folder):
    return met.file_metrics(t.files(spark, folder)).select("file_id", "issue_count")


# Duplication ------------------------------------------------------------------------------------

@query(s.with_ctes("dup", "SELECT * FROM dup WHERE n_lines > 0"))
def duplication_pct(spark, folder):
    return dup.duplication(t.files(spark, folder))


@query(s.with_ctes(
    "code_lines",
    f"SELECT n_lines, n_duplicated, {s.round_exact('pct', 1)} AS duplication_pct FROM pct", pct="""
    SELECT sum(n)::BIGINT AS n_lines, sum(n - 1)::BIGINT AS n_duplicated,
           sum(n - 1)::DOUBLE / sum(n) * 100 AS pct
    FROM (SELECT count(*) AS n FROM code_lines GROUP BY stripped)"""))
def duplication_global(spark, folder):
    return dup.duplication(t.files(spark, folder), by_review=False)


@query(s.with_ctes("code_lines", """
    SELECT stripped AS line, count(*) AS n_occurrences, count(DISTINCT file_id) AS n_files
    FROM code_lines GROUP BY stripped HAVING count(*) > 1"""))
def duplicate_lines(spark, folder):
    return dup.duplicate_lines(t.files(spark, folder))


@query(s.with_ctes("numbered", """
    SELECT file_id, min(first_line)::INTEGER AS first_line, max(last_line)::INTEGER AS last_line,
           count(*) + 5 AS n_lines, origin_file_id, min(origin_line)::INTEGER AS origin_line
    FROM islands GROUP BY file_id, origin_file_id, ahead, island""",
    kept_lines=rf"""
    SELECT file_id, line_no, stripped, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS place
    FROM (SELECT file_id, line_no, regexp_replace(line, '^[{s.SPACE}]+|[{s.SPACE}]+$', '', 'g') AS stripped
          FROM numbered)
    WHERE length(stripped) > 10 AND NOT starts_with(stripped, '#')""", line_runs="""
    SELECT file_id, place, line_no AS first_line, list(line_no) OVER six AS nos, list(stripped) OVER six AS run
    FROM kept_lines
    WINDOW six AS (PARTITION BY file_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)""", links="""
    SELECT file_id, place, first_line, nos[6] AS last_line,
           first_value(file_id) OVER firsts AS origin_file_id, first_value(place) OVER firsts AS origin_place,
           first_value(first_line) OVER firsts AS origin_line
    FROM line_runs WHERE len(run) = 6
    WINDOW firsts AS (PARTITION BY run ORDER BY file_id, place)""", islands="""
    SELECT *, place - origin_place AS ahead, place - row_number() OVER (
        PARTITION BY file_id, origin_file_id, place - origin_place ORDER BY place) AS island
    FROM links WHERE (file_id, place) <> (origin_file_id, origin_place)"""))
def duplicate_blocks(spark, folder):
    return blocks.duplicate_blocks(t.files(spark, folder))


# Reviews of files -------------------------------------------------------------------------------

@query(s.with_ctes("review_metrics", "SELECT review_id, critical_issues, error_issues,"
                   " warning_issues, info_issues FROM review_metrics"))
def severity_counts(spark, folder):
    return met.review_totals(met.file_metrics(t.files(spark, folder))).select(
        "review_id", "critical_issues", "error_issues", "warning_issues", "info_issues")


@query(s.with_ctes("review_metrics", "SELECT review_id, total_files, total_lines, total_issues"
                   " FROM review_metrics"))
def review_totals(spark, folder):
    return met.review_totals(met.file_metrics(t.files(spark, folder))).select(
        "review_id", "total_files", "total_lines", "total_issues")


@query(s.with_ctes("review_metrics", "SELECT review_id, quality_score, maintainability,"
                   " avg_complexity FROM review_metrics"))
def review_averages(spark, folder):
    return met.review_averages(met.file_metrics(t.files(spark, folder)))


def _fill(template: str, **columns: str) -> str:
    out = s.quote(template)
    for name, column in columns.items():
        out = f"replace({out}, '{{{name}}}', ({column})::VARCHAR)"
    return out


_COLUMNS = {
    "files": "total_files", "total": "total_issues", "critical": "critical_issues",
    "error": "error_issues", "warning": "warning_issues",
    "score": "round_even(quality_score, 0)::BIGINT",
    "index": "round_even(maintainability, 0)::BIGINT",
    "remark": f"CASE WHEN total_issues > 0 THEN {s.quote(p.REMARK_SOME)}"
              f" ELSE {s.quote(p.REMARK_NONE)} END",
}
SUMMARY_SQL = (
    f"CASE WHEN quality_score >= 85 THEN {_fill(p.SUMMARY_EXCELLENT, **_COLUMNS)}"
    f" WHEN quality_score >= 65 THEN {_fill(p.SUMMARY_MODERATE, **_COLUMNS)}"
    f" WHEN quality_score >= 45 THEN {_fill(p.SUMMARY_ATTENTION, **_COLUMNS)}"
    f" ELSE {_fill(p.SUMMARY_CRITICAL, **_COLUMNS)} END")
PRAISE_SQL = (
    f"CASE WHEN avg_complexity < 5 THEN {s.quote(p.PRAISE_COMPLEXITY)}"
    f" WHEN duplication_pct < 5 THEN {s.quote(p.PRAISE_DUPLICATION)}"
    f" WHEN quality_score > 70 THEN {s.quote(p.PRAISE_STRUCTURE)}"
    f" ELSE {s.quote(p.PRAISE_CONSISTENT)} END")
PRIORITY_SQL = (
    f"CASE WHEN critical_issues > 0 THEN {_fill(p.PRIORITY_CRITICAL, **_COLUMNS)}"
    f" WHEN error_issues > 0 THEN {_fill(p.PRIORITY_ERROR, **_COLUMNS)}"
    f" WHEN warning_issues > 0 THEN {_fill(p.PRIORITY_WARNING, **_COLUMNS)}"
    f" ELSE {s.quote(p.PRIORITY_INFO)} END")


@query(s.with_ctes("review_metrics", f"""
    SELECT *, {SUMMARY_SQL} AS summary, {PRAISE_SQL} AS praise, {PRIORITY_SQL} AS priority
    FROM review_metrics"""))
def review_metrics(spark, folder):
    return met.review_metrics(t.files(spark, folder)).drop("n_failed")


@query(s.with_ctes("review_metrics",
                   f"SELECT review_id, {SUMMARY_SQL} AS summary FROM review_metrics"))
def review_summary(spark, folder):
    return met.review_metrics(t.files(spark, folder)).select("review_id", "summary")


@query(s.with_ctes("review_metrics",
                   f"SELECT review_id, {PRAISE_SQL} AS praise FROM review_metrics"))
def review_praise(spark, folder):
    return met.review_metrics(t.files(spark, folder)).select("review_id", "praise")


@query(s.with_ctes("review_metrics",
                   f"SELECT review_id, {PRIORITY_SQL} AS priority FROM review_metrics"))
def review_priority(spark, folder):
    return met.review_metrics(t.files(spark, folder)).select("review_id", "priority")


@query(s.with_ctes("review_metrics", f"""
    SELECT review_id, {s.band('avg_complexity', p.COMPLEXITY_BANDS, 'ok', '>')} AS complexity_band,
           {s.band('duplication_pct', p.DUPLICATION_BANDS, 'ok', '>')} AS duplication_band
    FROM review_metrics"""))
def metric_bands(spark, folder):
    return met.review_metrics(t.files(spark, folder)).select(
        "review_id", p.complexity_band(F.col("avg_complexity")).alias("complexity_band"),
        p.duplication_band(F.col("duplication_pct")).alias("duplication_band"))


@query(s.with_ctes("v_files", r"""
    SELECT file_id, regexp_replace(filename, '\.[^.]+$', '') || ' — Code Review' AS title
    FROM v_files"""))
def default_title(spark, folder):
    return t.files(spark, folder).select(
        "file_id", p.default_title(F.col("filename")).alias("title"))
