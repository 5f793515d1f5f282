"""Connected components by alternating large-star and small-star rounds over stored tables.

A link is a pair of long node numbers. A large star ties every larger neighbour
of a node to the least node of its neighbourhood, a small star ties the node and
its smaller neighbours to the least of them. Both keep the components, and where
neither changes a link any more every node hangs directly on the least node of
its component. Only links move; no node gathers its neighbourhood in one row, so
a hub is an ordinary join key that AQE may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.storage import stored


def _hang(ends: DataFrame, moved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``moved(a, b)`` with ``m``, the least of the ``b`` that ``ends`` has for ``a``; and those least ones.

    The least ones are stored, so that both sides of the join are plain exchanges.
    """
    least = stored(ends.groupBy("a").agg(F.min("b").alias("m")))
    return moved.join(least, "a"), least


def large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hung, _ = _hang(both, both.filter("b > a"))
    return hung.select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    hung, least = _hang(down, down)
    return hung.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(
        least.select("a", F.col("m").alias("b"))
    ).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected(links: DataFrame) -> DataFrame:
    """``links(a, b)`` to ``(node, root)``, root the least node reachable; nodes without a link to another don't appear.

    Links may repeat, point either way, be loops, and form chains, hubs and
    cycles; no link at all gives an empty table. Rounds grow with the logarithm
    of the longest chain.
    """
    now = stored(links.select("a", "b").filter("a <> b").distinct())
    mark = _mark(now)
    while mark[0]:
        now = stored(small_star(stored(large_star(now))))
        before, mark = mark, _mark(now)
        if mark == before:
            break
    hung = now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return hung.unionByName(hung.select(F.col("root").alias("node"), "root").distinct())
