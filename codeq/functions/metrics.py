"""Per-file metrics as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeq.functions.text import WORD, WORD_EDGE, WORD_END, WORD_START, count_matches
from codeq.rules.catalogue import EXTENSION_LANGUAGE

# The words that count as branches and as operators, and the operator signs.
BRANCH_WORDS = ("if", "else", "elif", "for", "while", "switch", "case", "catch")
SIGNS = r"+\-*/%&|^~<>"

# The look-ahead is cheap and rules out most places in a text at once.
BRANCH = (
    rf"(?=[{''.join(sorted({w[0] for w in BRANCH_WORDS}))}&|])(?:{WORD_START}(?:{'|'.join(BRANCH_WORDS)}){WORD_END}"
    rf"|(?<=[{WORD}])(?:&&|\|\|)(?=[{WORD}]))"
)
# A sign with or without =, then == and !=, then and, or, not, in, is as whole words; again a
# look-ahead first.
OPERATOR = (
    rf"(?=[{SIGNS}=!aoni])(?:[{SIGNS}]=?|[=!]="
    rf"|{WORD_START}(?:and|or|not|in|is){WORD_END})"
)
# Names and numbers.
OPERAND = (
    rf"(?=[a-zA-Z_]){WORD_START}[{WORD}]++"
    rf"|(?=\p{{Nd}}){WORD_START}\p{{Nd}}+\.?\p{{Nd}}*{WORD_EDGE}"
)

# Points off per finding.
SEVERITY_WEIGHT = {"critical": 15.0, "error": 8.0, "warning": 3.0, "info": 0.5}


def extension(filename: Column) -> Column:
    """Lower-case text after the last dot; null without a dot."""
    return F.when(F.contains(filename, F.lit(".")),
                  F.lower(F.substring_index(filename, ".", -1)))


def language(filename: Column) -> Column:
    pairs = [F.lit(x) for pair in EXTENSION_LANGUAGE.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[extension(filename)], F.lit("unknown"))


def comment_ratio(comments: Column, loc: Column) -> Column:
    return comments / F.greatest(loc, F.lit(1))


def branch_complexity(text: Column) -> Column:
    """Cyclomatic complexity guessed from branch words, for languages without a parser."""
    return (count_matches(text, BRANCH) + 1).cast("double")


def operators(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(OPERATOR), F.lit(0))


def operands(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(OPERAND), F.lit(0))


def halstead_volume(operator_list: Column, operand_list: Column) -> Column:
    length = F.size(operator_list) + F.size(operand_list)
    vocabulary = F.size(F.array_distinct(operator_list)) + F.size(F.array_distinct(operand_list))
    return F.when(vocabulary < 2, F.lit(0.0)).otherwise(
        F.round(length * F.log2(vocabulary.cast("double")), 2)
    )


def maintainability(volume: Column, complexity: Column, loc: Column, ratio: Column) -> Column:
    index = (
        171
        - 5.2 * F.log(F.greatest(volume, F.lit(1.0)))
        - 0.23 * complexity
        - 16.2 * F.log(F.greatest(loc, F.lit(1)).cast("double"))
        + 50 * F.sin(F.sqrt(2.4 * ratio))
    )
    return F.when(loc < 1, F.lit(100.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(index, 1)))
    )


def quality(counts: dict[str, Column], complexity: Column, index: Column) -> Column:
    """Score 0-100 from findings per severity, complexity and maintainability index."""
    score = F.lit(100.0)
    for severity, weight in SEVERITY_WEIGHT.items():
        score = score - counts[severity] * weight
    score = score - (F.when(complexity > 20, 15.0).when(complexity > 10, 8.0)
                     .when(complexity > 7, 3.0).otherwise(0.0))
    score = score + F.when(index > 80, 5.0).when(index < 40, -10.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
