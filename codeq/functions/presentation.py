"""Labels, bands and texts shown to people."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeq.functions.rounding import fixed_text

# Lower bound of each label and band, best first.
SCORE_LABELS = ((85, "Excellent"), (70, "Good"), (55, "Fair"), (40, "Poor"))
SCORE_BANDS = ((80, "high"), (60, "medium"), (40, "low"))
COMPLEXITY_BANDS = ((10, "high"), (7, "medium"))
DUPLICATION_BANDS = ((15, "high"), (5, "medium"))
MEDALS = {1: "gold", 2: "silver", 3: "bronze"}

# The review texts.
SUMMARY_EXCELLENT = (
    "This is high-quality code across {files} file(s). With a quality score of {score}/100 and "
    "maintainability index of {index}/100, the codebase demonstrates good engineering practices. "
    "{remark}"
)
REMARK_SOME = "A few minor improvements are suggested."
REMARK_NONE = "No significant issues were found."
SUMMARY_MODERATE = (
    "Code quality is moderate across {files} file(s) (score: {score}/100). {total} issue(s) were "
    "found, including {critical} critical item(s) that should be addressed before production. "
    "The maintainability index of {index}/100 suggests some technical debt is present."
)
SUMMARY_ATTENTION = (
    "Code quality needs attention — scored {score}/100 across {files} file(s). {total} issues "
    "detected, {critical} of which are critical security or reliability risks. Significant "
    "refactoring is recommended before this code enters production."
)
SUMMARY_CRITICAL = (
    "Critical code quality issues detected — scored {score}/100 across {files} file(s). "
    "{critical} critical and {error} error-level issues require immediate attention. This code "
    "poses security and reliability risks in its current state."
)
PRAISE_COMPLEXITY = "Functions are well-scoped with low complexity — easy to test and maintain."
PRAISE_DUPLICATION = "Code duplication is minimal — good DRY (Don't Repeat Yourself) discipline."
PRAISE_STRUCTURE = "Overall structure is clean and follows common conventions."
PRAISE_CONSISTENT = "Code is structured consistently across files."
PRIORITY_CRITICAL = (
    "🚨 Fix {critical} critical security/reliability issue(s) immediately. These could lead to "
    "security vulnerabilities or data loss in production."
)
PRIORITY_ERROR = (
    "⚠️ Address {error} error-level issue(s). These include bad practices that could cause "
    "runtime failures."
)
PRIORITY_WARNING = (
    "📋 Review {warning} warning(s). These represent maintainability and performance improvements."
)
PRIORITY_INFO = (
    "✅ Address the informational suggestions to further improve code quality and documentation."
)
TITLE_SUFFIX = " — Code Review"


def fill(template: str, **values: Column) -> Column:
    """The template with each ``{name}`` replaced by a column's text."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        head, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(head), values[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def band(value: Column, bounds: Sequence[tuple[float, str]], other: str,
         inclusive: bool = True) -> Column:
    """Name of the first band whose bound the value reaches (or exceeds)."""
    out = None
    for bound, name in bounds:
        hit = value >= bound if inclusive else value > bound
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def score_label(score: Column) -> Column:
    return band(score, SCORE_LABELS, "Critical")


def score_band(score: Column) -> Column:
    return band(score, SCORE_BANDS, "critical")


def complexity_band(value: Column) -> Column:
    return band(value, COMPLEXITY_BANDS, "ok", inclusive=False)


def duplication_band(value: Column) -> Column:
    return band(value, DUPLICATION_BANDS, "ok", inclusive=False)


def medal(rank: Column) -> Column:
    out = None
    for place, name in MEDALS.items():
        out = F.when(rank == place, name) if out is None else out.when(rank == place, name)
    return out


def review_summary(score: Column, index: Column, files: Column, total: Column,
                   critical: Column, error: Column) -> Column:
    values = {
        "files": files, "total": total, "critical": critical, "error": error,
        "score": F.bround(score, 0).cast("long"), "index": F.bround(index, 0).cast("long"),
        "remark": F.when(total > 0, REMARK_SOME).otherwise(REMARK_NONE),
    }
    return (
        F.when(score >= 85, fill(SUMMARY_EXCELLENT, **values))
        .when(score >= 65, fill(SUMMARY_MODERATE, **values))
        .when(score >= 45, fill(SUMMARY_ATTENTION, **values))
        .otherwise(fill(SUMMARY_CRITICAL, **values))
    )


def review_praise(complexity: Column, duplication: Column, score: Column) -> Column:
    return (
        F.when(complexity < 5, PRAISE_COMPLEXITY)
        .when(duplication < 5, PRAISE_DUPLICATION)
        .when(score > 70, PRAISE_STRUCTURE)
        .otherwise(PRAISE_CONSISTENT)
    )


def review_priority(critical: Column, error: Column, warning: Column) -> Column:
    return (
        F.when(critical > 0, fill(PRIORITY_CRITICAL, critical=critical))
        .when(error > 0, fill(PRIORITY_ERROR, error=error))
        .when(warning > 0, fill(PRIORITY_WARNING, warning=warning))
        .otherwise(PRIORITY_INFO)
    )


def time_ago(then: Column, now: Column) -> Column:
    """Age in whole days, hours or minutes."""
    minutes = F.floor(F.timestamp_diff("SECOND", then, now) / 60)
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)
    return (
        F.when(days > 0, F.concat(days.cast("string"), F.lit("d ago")))
        .when(hours > 0, F.concat(hours.cast("string"), F.lit("h ago")))
        .when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m ago")))
        .otherwise("Just now")
    )


def duration_text(milliseconds: Column) -> Column:
    return F.when(milliseconds < 1000, F.concat(milliseconds.cast("string"), F.lit("ms"))
                  ).otherwise(F.concat(fixed_text(milliseconds / 1000.0, 1), F.lit("s")))


def kilobytes_text(n_bytes: Column) -> Column:
    return F.concat(fixed_text(n_bytes / 1024.0, 1), F.lit(" KB"))


def default_title(filename: Column) -> Column:
    return F.concat(F.regexp_replace(filename, r"\.[^.]+\z", ""), F.lit(TITLE_SUFFIX))


def first_name(full_name: Column) -> Column:
    """Text before the first blank, or the word used where there is no name."""
    name = F.substring_index(full_name, " ", 1)
    return F.when(F.length(name) > 0, name).otherwise("developer")


def coerce(value: Column, domain: Sequence[str], other: str = "unknown") -> Column:
    """The value if it belongs to the domain."""
    return F.when(value.isin(*domain), value).otherwise(other)
