"""Repeated lines within a review and over the whole corpus.

A popular line is counted on the map side first, so it costs one row per task however often it
occurs; no list of the files that hold a line is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeq.functions.rounding import round_exact
from codeq.functions.text import split_lines, strip

MIN_CHARS = 10


def _kept_lines(lines: Column | None = None) -> Column:
    """Stripped lines of ``content``: more than 10 characters and no ``#`` comments."""
    stripped = F.transform(split_lines(F.col("content")) if lines is None else lines, strip)
    return F.filter(stripped, lambda x: (F.length(x) > MIN_CHARS) & ~F.startswith(x, F.lit("#")))


def line_hash(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def line_hashes(lines: Column) -> Column:
    """16 bytes for each line of a file that counts, from the file's lines."""
    return F.transform(_kept_lines(lines), line_hash)


def code_lines(files: DataFrame) -> DataFrame:
    """One row per line that counts for duplication."""
    return files.select("review_id", "file_id", F.explode(_kept_lines()).alias("line"))


def _share(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Share of lines that repeat another, per key, from counts per distinct line."""
    sums = counts.groupBy(*keys).agg(F.sum("n").alias("total"),
                                     F.sum(F.col("n") - 1).alias("repeated"))
    ratio = sums.select(
        *keys, F.coalesce(F.col("total"), F.lit(0)).alias("n_lines"),
        F.coalesce(F.col("repeated"), F.lit(0)).alias("n_duplicated"))
    return with_share(ratio)


def with_share(counts: DataFrame) -> DataFrame:
    """``counts`` with duplication_pct, from n_lines and n_duplicated."""
    pct = counts.withColumn(
        "pct", F.col("n_duplicated") / F.greatest(F.col("n_lines"), F.lit(1)) * 100)
    return pct.withColumn("duplication_pct", round_exact(F.col("pct"), 1)).drop("pct")


def duplication(files: DataFrame, by_review: bool = True) -> DataFrame:
    """n_lines, n_duplicated and duplication_pct, per review or over everything."""
    keys = ["review_id"] if by_review else []
    lines = code_lines(files).select(*keys, line_hash(F.col("line")).alias("h"))
    return _share(lines.groupBy(*keys, "h").agg(F.count("*").alias("n")), keys)


def line_changes(changes: DataFrame) -> DataFrame:
    """Counts (review_id, h, n) that files with a ``sign`` of 1 add and those with -1 take away."""
    lines = changes.select("review_id", "sign", F.explode(_kept_lines()).alias("line"))
    return lines.groupBy("review_id", line_hash(F.col("line")).alias("h")).agg(F.sum("sign").cast("long").alias("n"))


def added_up(counts: DataFrame) -> DataFrame:
    """Counts of lines summed; lines that are gone leave no row."""
    return counts.groupBy("review_id", "h").agg(F.sum("n").alias("n")).filter("n <> 0")


def duplication_of(counts: DataFrame) -> DataFrame:
    """``duplication`` per review from counts per line; reviews without lines have no row."""
    return _share(counts, ["review_id"])


def duplicate_lines(files: DataFrame) -> DataFrame:
    """Every line that occurs more than once: how often and in how many files.

    A file is one row, so its own repeats are told apart there, by sorting its lines; counting
    files then takes no grouping by (line, file) and the text is shuffled once.
    """
    in_order = files.select(F.array_sort(_kept_lines()).alias("sorted"))
    marked = F.expr("transform(sorted, (line, i) -> struct(line as line,"
                    " if(i > 0 and line = sorted[i - 1], 0L, 1L) as is_first))")
    return (in_order.select(F.explode(marked).alias("x")).groupBy(F.col("x.line").alias("line"))
            .agg(F.count("*").alias("n_occurrences"), F.sum("x.is_first").alias("n_files"))
            .filter(F.col("n_occurrences") > 1))
