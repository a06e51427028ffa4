"""States as of a time: validity intervals from events, and the state that held at each of many times.

A key's events are cut by day. Windows run over the rows of one day of a key and over one row per day,
so a key with very many events is not one task. Keys that are known to have few rows can stay whole.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _by_day(df: DataFrame, time: str) -> DataFrame:
    return df.withColumn("_day", F.date_trunc("day", time))


def intervals(events: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str]) -> DataFrame:
    """The events with ``valid_until``, the time of the key's next one; null for the last.

    Events of one time are in the order of ``ties``, and all but the last hold for no time. Events
    without a time are left out, as they are nowhere in the order.
    """
    days = [*keys, "_day"]
    cut = _by_day(events.filter(F.col(time).isNotNull()), time)
    begins = cut.groupBy(*days).agg(F.min(time).alias("_begins")).withColumn(
        "_next", F.lead("_begins").over(Window.partitionBy(*keys).orderBy("_day")))
    within = F.lead(time).over(Window.partitionBy(*days).orderBy(time, *ties))
    return _joined(cut.withColumn("_within", within), begins, days).select(
        *[F.col(f"a.{c}") for c in events.columns],
        F.coalesce("a._within", "b._next").alias("valid_until"))


def _joined(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """The two as ``a`` and ``b``, joined where these columns are equal or both null."""
    return left.alias("a").join(right.alias("b"), reduce(
        operator.and_, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on]))


def as_of(asked: DataFrame, events: DataFrame, keys: Sequence[str], time: str, values: Sequence[str],
          ties: Sequence[str] = (), few: bool = False) -> DataFrame:
    """The rows of ``asked`` with the values of their key's last event up to their time.

    Both have the keys and ``time``. An event of the very time counts; of several events of one time
    the last by ``ties`` and ``values`` does. Rows before any event, or without a time, have nulls.
    With ``few`` the rows of a key are not cut by day; nothing is shuffled where both tables are dealt
    to the same partitions by some of the keys.
    """
    own = [c for c in asked.columns if c not in {*keys, time}]
    order = [time, "_asks", *[f"_state.{c}" for c in (*ties, *values)]]
    state = F.struct(*dict.fromkeys((*ties, *values)))
    told = events.filter(F.col(time).isNotNull()).select(
        *keys, time, state.alias("_state"), F.lit(0).alias("_asks"))
    rows = told.unionByName(asked.select(
        *keys, time, F.struct(*own).alias("_own") if own else F.lit(None).alias("_own"),
        F.lit(1).alias("_asks")), allowMissingColumns=True)
    if few:
        days, cut = list(keys), rows
    else:
        days, rows = [*keys, "_day"], _by_day(rows, time)
        at_end = F.max(F.when(F.col("_asks") == 0, F.struct(time, "_state")))
        before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
        # A day that is asked about begins with the state carried to it, where there is one.
        carried = rows.groupBy(*days).agg(at_end.alias("_end"), F.max("_asks").alias("_asked")).select(
            *days, "_asked", F.last("_end", ignorenulls=True).over(before)["_state"].alias("_state")).filter(
            "_asked = 1 and _state is not null and _day is not null").select(*days, "_state", F.lit(-1).alias("_asks"))
        cut = rows.unionByName(carried, allowMissingColumns=True)
        order = [F.col("_asks") >= 0, *order]
    so_far = Window.partitionBy(*days).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = cut.withColumn("_held", F.last("_state", ignorenulls=True).over(so_far)).filter("_asks = 1")
    return held.select(
        *[F.col(c) if c in {*keys, time} else F.col(f"_own.{c}").alias(c) for c in asked.columns],
        *[F.col(f"_held.{c}").alias(c) for c in values])
