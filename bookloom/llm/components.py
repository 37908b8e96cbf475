"""Connected components of a graph given as a frame of links.

Alternates two steps that bring every node closer to the smallest node of its
component until nothing changes: larger neighbours are tied to the smallest
neighbour, then smaller neighbours are tied to the smallest one. Each step is
an aggregate, combined before its shuffle, and a join that adaptive execution
can split, so a node with very many links is no one task's burden. Every round
is written to the shared folder; only a count and two sums reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.llm.common import stored


def _state(links: DataFrame) -> tuple:
    """Tells two sets of links apart."""
    mark = F.xxhash64("a", "b")
    return tuple(
        links.agg(
            F.count("*"), F.bit_xor(mark), F.sum(F.shiftright(mark, 20))
        ).first()
    )


def _large(links: DataFrame) -> DataFrame:
    both = stored(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))),
        "links-both",
    )
    least = stored(
        both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "links-least"
    )
    return (
        both.join(least, "a")
        .where(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )


def _small(links: DataFrame) -> DataFrame:
    """Links come as (a larger, b smaller)."""
    down = stored(links, "links-down")
    least = stored(down.groupBy("a").agg(F.min("b").alias("m")), "links-least")
    tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return tied.union(own).where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is linked to, for linked nodes.

    ``links`` has two columns of node numbers. Repeated links, links in both
    directions and links to oneself are fine; links with a null are left out; no
    links give no rows.
    """
    a, b = (F.col(f"`{c}`") for c in links.columns)
    now = stored(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .where(a.isNotNull() & b.isNotNull() & (a != b))
        .distinct(),
        "links",
    )
    before = _state(now)
    while before[0]:
        now = stored(_small(_large(now)), "links")
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
