"""Suggested names, as columns and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeq.functions.sqltext import literal


def snake_sql(name: str) -> str:
    before_word = literal("(?d)(.)([A-Z][a-z]+)")
    before_capital = literal("([a-z0-9])([A-Z])")
    return (f"lower(regexp_replace(regexp_replace({name}, {before_word}, '$1_$2'),"
            f" {before_capital}, '$1_$2'))")


def pascal_sql(name: str) -> str:
    """Each run of letters capitalised, underscores dropped."""
    runs = f"regexp_extract_all({name}, {literal(r'\p{L}+|[^\p{L}]+')}, 0)"
    titled = f"transform({runs}, r -> concat(upper(left(r, 1)), lower(substr(r, 2))))"
    return f"replace(array_join({titled}, ''), '_', '')"


def to_snake(column: str) -> Column:
    return F.expr(snake_sql(column))


def to_pascal(column: str) -> Column:
    return F.expr(pascal_sql(column))
