"""The pattern-rule scan: files in, one row per match out, in one pass and without a shuffle.

Each rule marks the start of every match with a private-use character; the marked text is then cut
at line feeds, so the number of marks on the n-th piece is the number of matches that start on line
n. That is linear in the text however many matches it holds, and stays inside the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeq.functions.sqltext import literal, struct
from codeq.functions.text import fold_case, java_pattern, split_lines, strip
from codeq.rules.catalogue import (
    CATEGORY_BY_PREFIX,
    PATTERN_RULES,
    SEVERITIES,
    PatternRule,
    rules_frame,
)

MARK = "\ue000"
STAND_IN = "\ue001"
SNIPPET_CHARS = 200


def _clean(text: Column) -> Column:
    """The text without the mark; no rule tells the stand-in from it."""
    return F.replace(text, F.lit(MARK), F.lit(STAND_IN))


def _may_match(rule: PatternRule) -> str:
    held = [f"contains(folded, {literal(n)})" for n in rule.must_hold]
    # Of null text a rule given needles has no matches, one without has null.
    return " or ".join(held if rule.needles or not held else ["clean is null", *held]) or "true"


def _matches(rule: PatternRule) -> str:
    """array<struct<rule_id, line_start>> of one rule in one text."""
    mark = literal(MARK)
    marked = f"regexp_replace(clean, {literal(java_pattern(rule.pattern))}, {literal(MARK + '$0')})"
    lines = (f"transform(split({marked}, '\n'),"
             " (line, i) -> struct(i + 1 as line_no, line as line))")
    hits = f"filter({lines}, x -> contains(x.line, {mark}))"
    match = struct(rule_id=literal(rule.rule_id), line_start="x.line_no")
    repeats = f"length(x.line) - length(replace(x.line, {mark}, ''))"
    return (f"if({_may_match(rule)},"
            f" flatten(transform({hits}, x -> array_repeat({match}, {repeats}))),"
            " cast(array() as array<struct<rule_id:string,line_start:int>>))")


def _count(rule: PatternRule) -> str:
    counted = f"regexp_count(clean, {literal(java_pattern(rule.pattern))})"
    return f"if({_may_match(rule)}, cast({counted} as bigint), 0L)"


def scan_input(files: DataFrame) -> DataFrame:
    """Files with the two texts the scan reads, each computed once."""
    return files.withColumn("clean", _clean(F.col("content"))).withColumn(
        "folded", fold_case(F.col("clean")))


def pattern_matches(rules: Sequence[PatternRule] = PATTERN_RULES) -> Column:
    """All matches of all rules in a row of ``scan_input``."""
    return F.expr(f"concat({', '.join(_matches(r) for r in rules)})")


def rule_match_counts(rules: Sequence[PatternRule] = PATTERN_RULES) -> dict[str, Column]:
    """Matches per rule in a row of ``scan_input``, without their lines."""
    return {r.rule_id: F.expr(_count(r)) for r in rules}


def severity_match_counts(rules: Sequence[PatternRule] = PATTERN_RULES) -> dict[str, Column]:
    """Matches per severity in a row of ``scan_input``."""
    return {s: F.expr(" + ".join(["0L", *[_count(r) for r in rules if r.severity == s]]))
            for s in SEVERITIES}


def severity_counts_of(findings: Column, text: Column, rules: Sequence[PatternRule] = PATTERN_RULES) -> dict[str, Column]:
    """``severity_match_counts`` from the findings of the same rules, without a second look at the text."""
    counts = {}
    for s in SEVERITIES:
        unsure = any(r.severity == s and not r.needles for r in rules)  # of null text such a rule has null
        counts[s] = F.when(text.isNotNull(), F.size(F.filter(findings, lambda f: f.severity == s))).otherwise(
            F.lit(None) if unsure else F.lit(0)).cast("long")
    return counts


def with_snippets(matches: str, lines: str) -> Column:
    """Matches with their line, stripped and cut to 200 characters; empty past the last line."""
    def snippet(line_no: Column) -> Column:
        line = F.when(line_no <= F.size(lines), F.get(lines, line_no - 1)).otherwise("")
        return F.substring(strip(line), 1, SNIPPET_CHARS)

    return F.transform(matches, lambda m: F.struct(
        m.rule_id.alias("rule_id"), m.line_start.alias("line_start"),
        snippet(m.line_start).alias("code_snippet")))


def scan_rules(files: DataFrame, rules: Sequence[PatternRule] = PATTERN_RULES,
               snippets: bool = False) -> DataFrame:
    """One row per match: review_id, file_id, rule_id, line_start and, if asked, code_snippet."""
    scanned = scan_input(files)
    if not snippets:
        return (scanned
                .select("review_id", "file_id", F.explode(pattern_matches(rules)).alias("m"))
                .select("review_id", "file_id", "m.rule_id", "m.line_start"))
    # The lines stay in the row until the snippet is cut, so that a file's lines are not
    # repeated for each of its matches.
    found = scanned.select(
        "review_id", "file_id",
        split_lines(F.col("content")).alias("lines"), pattern_matches(rules).alias("matches"))
    return (found.select("review_id", "file_id",
                         F.explode(with_snippets("matches", "lines")).alias("m"))
            .select("review_id", "file_id", "m.rule_id", "m.line_start", "m.code_snippet"))


def count_rules(files: DataFrame, rules: Sequence[PatternRule] = PATTERN_RULES) -> DataFrame:
    """Matches per rule over all files; zero where a rule never fires."""
    counts = rule_match_counts(rules)
    totals = scan_input(files).agg(*[F.sum(c).alias(rule_id) for rule_id, c in counts.items()])
    return totals.unpivot([], list(counts), "rule_id", "n_matches").withColumn(
        "n_matches", F.coalesce("n_matches", F.lit(0).cast("long")))


def enrich(findings: DataFrame, rules: Sequence[PatternRule] = PATTERN_RULES) -> DataFrame:
    """Findings with severity, category, title, message and fix of their rule.

    The rule side is the catalogue itself, one row per rule, so broadcasting it is bounded.
    """
    return findings.join(F.broadcast(rules_frame(findings.sparkSession, tuple(rules))), "rule_id")


def category_of(rule_id: Column) -> Column:
    """Category from the prefix of a rule id."""
    out = None
    for prefix, category in CATEGORY_BY_PREFIX.items():
        hit = F.startswith(rule_id, F.lit(prefix))
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise("maintainability")
