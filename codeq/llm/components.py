"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeq.llm.common import drop, recorded, settle


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least one around it; links point downwards."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = settle(both.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m")), "least")
    return links.join(least, "v").select("u", F.least("v", "m").alias("v"))


def _small_star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The least neighbour below each node, and the links that lead its other ones there; links point downwards."""
    least = settle(links.groupBy("u").agg(F.min("v").alias("m")), "least")
    lower = links.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.withColumnRenamed("m", "v"), lower


def _told(links: DataFrame) -> tuple:
    """What tells a table of links from others: their number and the sum of their hashes."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def below_roots(links: DataFrame) -> DataFrame:
    """(node, root) of every node that a link leads to a lesser one; the root is the least node reachable.

    ``links`` has two columns of a type with an order. No list of neighbours is ever gathered: stars
    are minima, written down, and joins with them, whose hot keys Spark splits. A star never has more links
    than it was made of, so equal ones are not looked for; the minima merge them. Of the tables written
    only the last is left.
    """
    spark, (a, b) = links.sparkSession, links.columns
    with recorded(held := []):  # the folder of ``links``
        links = settle(links.filter(F.col(a) != F.col(b)).select(
            F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), "links")
    single = False  # whether each node has one link downwards
    while True:
        with recorded(own := []):
            large = settle(_large_star(links), "links")
            if single and _told(large) == _told(links):
                break  # no node that is led to is led on
            least, lower = _small_star(large)
            links = settle(lower.union(least), "links")
            single = links.count() == least.count()
        drop(spark, [*held, *own[:-1]])
        held = own[-1:]
    drop(spark, own)
    return links.toDF("node", "root")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link, as ``below_roots`` and with the roots themselves."""
    below = below_roots(links)
    return below.union(below.select("root", "root").distinct())
