"""Checks of the rules the tables must obey."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def audit_unique(checks: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Values that occur more than once though they should not: check, value, n."""
    return _union([
        df.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1").select(
            F.lit(name).alias("check"),
            F.concat_ws("/", *[F.col(c).cast("string") for c in columns]).alias("value"), "n")
        for name, (df, columns) in checks.items()])


def audit_references(edges: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Per edge: child rows that refer to something, and those whose parent is missing.

    Children are counted per reference first, so a popular parent is one row in the join.
    """
    parts = []
    for name, (children, reference, parents, key) in edges.items():
        used = children.filter(F.col(reference).isNotNull()).groupBy(
            F.col(reference).alias("ref")).agg(F.count("*").alias("n"))
        known = parents.select(F.col(key).alias("ref"), F.lit(True).alias("known"))
        joined = used.join(known.dropDuplicates(["ref"]), "ref", "left")
        parts.append(joined.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
            F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0))
            .alias("n_orphans")).withColumn("edge", F.lit(name)))
    return _union(parts)


def audit_domains(checks: dict[str, tuple[DataFrame, str, tuple[str, ...]]]) -> DataFrame:
    """Every value of a column that has a fixed domain, and whether it belongs to it."""
    return _union([
        df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).select(
            F.lit(name).alias("check"), "value", "n", F.col("value").isin(*domain).alias("ok"))
        for name, (df, column, domain) in checks.items()])


def audit_texts(checks: dict[str, tuple[DataFrame, dict[str, int]]]) -> DataFrame:
    """Missing and overlong values per text column; one pass over each table."""
    parts = []
    for table, (df, limits) in checks.items():
        counted = df.agg(*[
            F.struct(F.lit(f"{table}.{c}").alias("check"),
                     F.count_if(F.col(c).isNull()).alias("n_null"),
                     F.count_if(F.length(c) > limit).alias("n_too_long")).alias(c)
            for c, limit in limits.items()])
        parts.append(counted.select(F.explode(F.array(*limits)).alias("r")).select("r.*"))
    return _union(parts)
