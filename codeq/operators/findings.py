"""The findings table: every rule over every file, in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeq.functions.sqltext import literal, struct
from codeq.functions.text import split_lines
from codeq.operators.scan import pattern_matches, scan_input, with_snippets
from codeq.operators.syntax import FINDING_FIELDS, syntax_findings, with_facts
from codeq.rules.catalogue import PATTERN_RULES, PatternRule


def _pattern_findings(rules: Sequence[PatternRule]) -> Column:
    """``matches`` as full findings; the catalogue is a constant map, so attaching needs no join."""
    details = ", ".join(
        f"{literal(r.rule_id)}, " + struct(
            category=literal(r.category), severity=literal(r.severity), title=literal(r.title),
            message=literal(r.message), is_fixable=literal(r.fixable),
            fix_description=literal(r.fix))
        for r in rules)
    own = {"rule_id": "m.rule_id", "line_start": "m.line_start", "line_end": "null",
           "code_snippet": "m.code_snippet"}
    rule = f"element_at(map({details}), m.rule_id)"
    finding = struct(**{name: f"cast({own.get(name, f'{rule}.{name}')} as {kind})"
                        for name, kind in FINDING_FIELDS.items()})
    return F.expr(f"transform(snippets, m -> {finding})")


def with_findings(files: DataFrame, rules: Sequence[PatternRule] = PATTERN_RULES) -> DataFrame:
    """Files with all their findings, in the arrays ``by_pattern`` and ``by_syntax``.

    A file's findings are bounded by its text, which already is one row.
    """
    scanned = scan_input(with_facts(files)).withColumn(
        "matches", pattern_matches(rules)).withColumn("lines", split_lines(F.col("content")))
    return scanned.withColumn("snippets", with_snippets("matches", "lines")).withColumns(
        {"by_pattern": _pattern_findings(rules), "by_syntax": syntax_findings()}
    ).drop("clean", "folded", "matches", "snippets", "lines")


def all_findings(files: DataFrame, rules: Sequence[PatternRule] = PATTERN_RULES) -> DataFrame:
    """One row per finding of any syntax rule and of these pattern rules."""
    # Two arrays joined here rather than one column: see explode_findings.
    found = F.concat("by_pattern", "by_syntax")
    return (with_findings(files, rules)
            .select("review_id", "file_id", F.explode(found).alias("f"))
            .select("review_id", "file_id", "f.*"))


def annotations(findings: DataFrame) -> DataFrame:
    """One row per file: map of line number to labels; files without such findings are left out.

    Grouped by (file, line) and then by file: both groups are bounded by the file's text.
    """
    label = F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.col("title"))
    on_lines = (
        findings.filter(F.col("line_start").isNotNull() & (F.col("line_start") != 0))
        .groupBy("file_id", "line_start").agg(F.sort_array(F.collect_list(label)).alias("labels"))
    )
    return on_lines.groupBy("file_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(
            F.struct(F.col("line_start").cast("string"), F.col("labels"))))).alias("annotations"))
