"""Running totals, positions and firsts per key that hold up when one key owns much of the table.

A plain window puts all rows of a key in one task. Here the order within a key is cut into coarse
groups, say minutes, and these into fine ones, say time and block of ids: totals come from a grouping
that combines early, windows run over totals, and only the rows of one fine group share a task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A column name, with a leading "-" for descending order.
Level = Sequence[str]

ID_BLOCK = 2**20
KEY_BUCKETS = 2**14  # keys are counted in so many buckets
HOT_SHARE = 1000  # a bucket is hot with a thousandth of all rows,
HOT_ROWS = 2**16  # and so many at least
DEALT_ROWS = 2**19  # rows of a partition, on average
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def _names(level: Level) -> list[str]:
    return [c.lstrip("-") for c in level]


def _order(level: Level) -> list[Column]:
    return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in level]


def by_time(df: DataFrame, time: str, number: str) -> DataFrame:
    """``df`` with ``minute`` and ``block``, which cut an order by time and then by number.

    A key has at most 525,600 minutes a year, however many rows.
    """
    return df.withColumns({"minute": F.date_trunc("minute", time),
                           "block": F.floor(F.col(number) / ID_BLOCK)})


def running_totals(df: DataFrame, keys: Sequence[str], coarse: Level, fine: Level, single: Level,
                   measures: dict[str, Column]) -> DataFrame:
    """``df`` with a running total per measure within each key, ordered by the three levels.

    ``coarse`` should have a bounded number of values per key, as their totals share a task, and
    ``fine`` a bounded number per coarse group, as these are held in one row; ``single`` orders the
    rows of a fine group, which share a task. Level columns must not be null. The input is read
    twice: for the totals, and for the rows.
    """
    own = {f"_{name}": column for name, column in measures.items()}
    rows = df.withColumns(own)
    sums = [F.sum(c).alias(c) for c in own]
    before = {c: f"{c}_before" for c in own}
    outer, inner = [*keys, *_names(coarse)], [*keys, *_names(coarse), *_names(fine)]

    def ahead(group: list[str], order: Level) -> list[Column]:
        earlier = Window.partitionBy(*group).orderBy(*_order(order)).rowsBetween(
            Window.unboundedPreceding, -1)
        return [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(b) for c, b in before.items()]

    in_coarse = rows.groupBy(*inner).agg(*sums).select("*", *ahead(outer, fine)).groupBy(*outer).agg(
        *sums, F.collect_list(F.struct(*_names(fine), *before.values())).alias("_fine"))
    offsets = in_coarse.select(*outer, *ahead(list(keys), coarse), "_fine").select(
        *outer, *before.values(), F.explode("_fine").alias("_f")).select(
        *outer, *[f"_f.{c}" for c in _names(fine)],
        *[(F.col(b) + F.col(f"_f.{b}")).alias(b) for b in before.values()])
    so_far = Window.partitionBy(*inner).orderBy(*_order(single)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return rows.join(offsets, inner).select(*df.columns, *[
        (F.sum(f"_{name}").over(so_far) + F.col(f"_{name}_before")).alias(name) for name in measures])


def with_positions(df: DataFrame, keys: Sequence[str], coarse: Level, fine: Level, single: Level,
                   name: str = "position") -> DataFrame:
    """``df`` with each row's place, from 1, within its key."""
    return running_totals(df, keys, coarse, fine, single, {name: F.lit(1).cast("long")})


def by_key_size(key: str, *tables: DataFrame) -> list[tuple[bool, tuple[DataFrame, ...]]]:
    """The tables in parts by ``key``: those of keys with few rows, and those of hot keys where there are any.

    The first are marked True and dealt by the key, all to the same partitions, so what is grouped by the key
    and more needs no other shuffle. Any of their keys has less than a thousandth of all rows, or few. The
    others are left as they are, for operators that cut a key's rows. Keys are counted at once, in buckets.
    """
    keys = reduce(DataFrame.union, [df.select(key) for df in tables])
    bucket = F.pmod(F.xxhash64(F.col(key).cast(keys.schema[key].dataType)), F.lit(KEY_BUCKETS))
    held = {r["bucket"]: r["count"] for r in keys.groupBy(bucket.alias("bucket")).count().collect()}
    rows = sum(held.values())
    hot = [b for b, n in held.items() if n >= max(HOT_ROWS, rows / HOT_SHARE)]
    wanted = max(keys.sparkSession.sparkContext.defaultParallelism, -(-rows // DEALT_ROWS))
    if not hot:
        return [(True, tuple(df.repartition(wanted, key) for df in tables))]
    return [(True, tuple(df.filter(~bucket.isin(hot)).repartition(wanted, key) for df in tables)),
            (False, tuple(df.filter(bucket.isin(hot)) for df in tables))]


def first_rows(df: DataFrame, keys: Sequence[str], order: Level, n: int,
               name: str = "place") -> DataFrame:
    """The first ``n`` rows of each key, with their place.

    Spark cuts each task's rows to ``n`` per key before the shuffle; the session's limit for that is
    raised where it is lower.
    """
    conf = df.sparkSession.conf
    if int(conf.get(GROUP_LIMIT)) < n:
        conf.set(GROUP_LIMIT, str(n))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*_order(order)))
    return df.withColumn(name, place).filter(F.col(name) <= n)
