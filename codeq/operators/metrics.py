"""File metrics, in the file's row, and their roll-up to reviews."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeq.functions import metrics as m
from codeq.functions import presentation as p
from codeq.functions.rounding import round_exact
from codeq.functions.text import (
    code_line_count,
    comment_line_count,
    long_line_count,
    split_lines,
)
from codeq.operators.duplication import line_hashes, with_share
from codeq.operators.findings import with_findings
from codeq.operators.rollups import SUMMED
from codeq.operators.scan import scan_input, severity_counts_of, severity_match_counts
from codeq.operators.syntax import (
    MAX_LINE,
    cognitive,
    cyclomatic,
    parsed,
    structure_findings,
    with_facts,
)
from codeq.rules.catalogue import PATTERN_RULES, SEVERITIES, PatternRule


def line_counts(files: DataFrame) -> DataFrame:
    """file_id, loc, blank_lines, comment_lines."""
    lines = F.col("lines")
    counted = files.select("file_id", split_lines(F.col("content")).alias("lines")).select(
        "file_id", code_line_count(lines).alias("loc"), F.size(lines).cast("long").alias("n_lines"),
        comment_line_count(lines).alias("comment_lines"))
    return counted.select(
        "file_id", "loc", (F.col("n_lines") - F.col("loc")).alias("blank_lines"), "comment_lines")


def halstead(files: DataFrame) -> DataFrame:
    """file_id and Halstead volume."""
    tokens = files.select("file_id", m.operators(F.col("content")).alias("operators"),
                          m.operands(F.col("content")).alias("operands"))
    return tokens.select(
        "file_id", m.halstead_volume(F.col("operators"), F.col("operands")).alias("volume"))


def _count_severity(findings: Column, severity: str) -> Column:
    return F.size(F.filter(findings, lambda f: f.severity == severity)).cast("long")


def _syntax_counts() -> dict[str, Column]:
    """Syntax findings per severity, from ``structure``, ``facts``, ``cyclomatic``, ``cognitive``."""
    is_parsed = parsed()
    cc, cog = F.col("cyclomatic"), F.col("cognitive")
    flag = lambda condition: F.when(is_parsed & condition, 1).otherwise(0).cast("long")
    counts = {s: _count_severity(F.col("structure"), s) for s in SEVERITIES}
    counts["critical"] += flag(cc > 20)
    counts["error"] += flag((cc > 10) & (cc <= 20))
    counts["warning"] += flag((cc > 7) & (cc <= 10)) + flag(cog > 15)
    counts["info"] += F.when(is_parsed, long_line_count(F.col("lines"), MAX_LINE)).otherwise(0)
    return {s: F.when(F.col("facts").isNull(), 0).otherwise(c).cast("long")
            for s, c in counts.items()}


def file_metrics(files: DataFrame, rules: Sequence[PatternRule] = PATTERN_RULES,
                 hashes: bool = False) -> DataFrame:
    """One row per file with all its metrics; a narrow job, nothing is shuffled.

    Findings are only counted here, so no finding rows are built. ``analysis_failed`` marks a file
    that the parser could neither read nor reject. ``hashes`` adds ``line_hashes``, from which the
    duplication of a review follows without a second look at the text.
    """
    measured = _measured(scan_input(with_facts(files)))
    more = [line_hashes(F.col("lines")).alias("line_hashes")] if hashes else []
    return _figures(measured, severity_match_counts(rules), *more)


def metrics_with_findings(files: DataFrame, rules: Sequence[PatternRule] = PATTERN_RULES) -> DataFrame:
    """``file_metrics`` with ``content`` and all findings of the file in the array ``found``; reads the text once."""
    measured = _measured(with_findings(files, rules))
    matched = severity_counts_of(F.col("by_pattern"), F.col("content"), rules)
    return _figures(measured, matched, "content", F.concat("by_pattern", "by_syntax").alias("found"))


def _measured(scanned: DataFrame) -> DataFrame:
    content, is_python = F.col("content"), F.col("facts").isNotNull()
    return (
        scanned
        .withColumn("lines", split_lines(content))
        .withColumn("operators", m.operators(content))
        .withColumn("operands", m.operands(content))
        .withColumn("structure", structure_findings())
        .withColumn("cyclomatic", F.when(is_python, cyclomatic().cast("double"))
                    .otherwise(m.branch_complexity(content)))
        .withColumn("cognitive", F.when(is_python, cognitive()).otherwise(0).cast("double"))
    )


def _figures(measured: DataFrame, matched: dict[str, Column], *more: Column | str) -> DataFrame:
    lines, facts, from_syntax = F.col("lines"), F.col("facts"), _syntax_counts()
    counted = measured.select(
        "review_id", "file_id", "filename", "language",
        code_line_count(lines).alias("loc"), F.size(lines).cast("long").alias("n_lines"),
        comment_line_count(lines).alias("comment_lines"),
        "cyclomatic", "cognitive",
        m.halstead_volume(F.col("operators"), F.col("operands")).alias("halstead"),
        *[(matched[s] + from_syntax[s]).alias(f"{s}_issues") for s in SEVERITIES],
        F.coalesce(F.exists(facts, lambda f: f.kind == "analysis_error"), F.lit(False))
        .alias("analysis_failed"),
        *more,
    )
    counts = {s: F.col(f"{s}_issues") for s in SEVERITIES}
    ratio = m.comment_ratio(F.col("comment_lines"), F.col("loc"))
    return (
        counted
        .withColumn("blank_lines", F.col("n_lines") - F.col("loc")).drop("n_lines")
        .withColumn("issue_count", reduce(lambda a, b: a + b, counts.values()))
        .withColumn("maintainability", m.maintainability(
            F.col("halstead"), F.col("cyclomatic"), F.col("loc"), ratio))
        .withColumn("quality_score",
                    m.quality(counts, F.col("cyclomatic"), F.col("maintainability")))
    )


def review_totals(metrics: DataFrame) -> DataFrame:
    """Files, lines and findings per review."""
    return metrics.groupBy("review_id").agg(
        F.count("*").alias("total_files"),
        F.sum("loc").alias("total_lines"),
        F.sum("issue_count").alias("total_issues"),
        *[F.sum(f"{s}_issues").alias(f"{s}_issues") for s in SEVERITIES])


def _total(column: str) -> Column:
    return F.sum(F.col(column).cast(SUMMED))


def review_averages(metrics: DataFrame) -> DataFrame:
    """Average score, maintainability and complexity per review.

    The measures are summed exactly, so the result does not depend on the order of rows.
    """
    sums = metrics.groupBy("review_id").agg(
        F.count("*").alias("n"), _total("quality_score").alias("q"),
        _total("maintainability").alias("mi"), _total("cyclomatic").alias("cc"))
    means = sums.select("review_id", *[
        (F.col(c).cast("double") / F.col("n")).alias(c) for c in ("q", "mi", "cc")])
    return means.select(
        "review_id", round_exact(F.col("q"), 1).alias("quality_score"),
        round_exact(F.col("mi"), 1).alias("maintainability"),
        round_exact(F.col("cc"), 2).alias("avg_complexity"))


def review_metrics(files: DataFrame, rules: Sequence[PatternRule] = PATTERN_RULES) -> DataFrame:
    """One row per review: totals, averages, duplication and the three texts; reads the text once.

    ``n_failed`` counts the files that could not be analysed. A file without text counts as an empty one.
    """
    whole = files.withColumn("content", F.coalesce("content", F.lit("")))
    return review_figures(file_metrics(whole, rules, hashes=True))


MEASURES = ("quality_score", "maintainability", "cyclomatic")


def review_figures(measured: DataFrame) -> DataFrame:
    """``review_metrics`` from file metrics with ``line_hashes``.

    A file becomes a row per line hash and one without, which has its figures. Grouped by review and
    hash first, so a popular line, or a review's files, are one row per task before the shuffle.
    """
    summed = {"total_files": F.lit(1).cast("long"), "total_lines": F.col("loc"),
              "total_issues": F.col("issue_count"),
              **{f"{s}_issues": F.col(f"{s}_issues") for s in SEVERITIES},
              "n_failed": F.col("analysis_failed").cast("long"),
              **{f"sum_{c}": F.col(c).cast(SUMMED) for c in MEASURES}}
    exploded = measured.select("review_id", *[c.alias(n) for n, c in summed.items()], F.explode(
        F.concat(F.array(F.lit(None).cast("binary")),
                 F.coalesce("line_hashes", F.array().cast("array<binary>")))).alias("h"))
    own = F.col("h").isNull()
    by_line = exploded.groupBy("review_id", "h").agg(
        F.count("h").alias("n"), *[F.sum(F.when(own, F.col(n))).alias(n) for n in summed])
    sums = by_line.groupBy("review_id").agg(
        *[F.sum(n).alias(n) for n in summed], F.sum("n").alias("n_lines"),
        F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("n_duplicated"))
    means = with_share(sums).withColumns({
        c: F.col(f"sum_{c}").cast("double") / F.col("total_files") for c in MEASURES})
    rounded = (
        means.withColumn("quality_score", round_exact(F.col("quality_score"), 1))
        .withColumn("maintainability", round_exact(F.col("maintainability"), 1))
        .withColumn("avg_complexity", round_exact(F.col("cyclomatic"), 2))
    )
    return with_texts(rounded.drop("cyclomatic", "n_lines", "n_duplicated", *[f"sum_{c}" for c in MEASURES]))


def with_texts(reviews: DataFrame) -> DataFrame:
    """Reviews with summary, praise and top priority."""
    score, critical, error = F.col("quality_score"), F.col("critical_issues"), F.col("error_issues")
    return (
        reviews
        .withColumn("summary", p.review_summary(
            score, F.col("maintainability"), F.col("total_files"), F.col("total_issues"),
            critical, error))
        .withColumn("praise", p.review_praise(
            F.col("avg_complexity"), F.col("duplication_pct"), score))
        .withColumn("priority", p.review_priority(critical, error, F.col("warning_issues")))
    )
