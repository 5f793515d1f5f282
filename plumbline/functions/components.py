"""Connected components by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

Store = Callable[[DataFrame], DataFrame]


def _large_star(pairs: DataFrame, store: Store) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of its neighbourhood."""
    both = store(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    least = store(both.groupBy("a").agg(F.min("b").alias("m")))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("m", F.col("a")).alias("b")).distinct()


def _small_star(pairs: DataFrame, store: Store) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least one."""
    down = store(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    least = store(down.groupBy("a").agg(F.min("b").alias("m")))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, store: Store = cut_lineage) -> DataFrame:
    """``links(a, b)`` of longs to ``(node, root)`` with the least node reachable; nodes without a link don't appear.

    Links may repeat, point either way and form chains or hubs. Tables are
    stored between joins, so both sides of a join are plain exchanges and AQE
    may split a hub.
    """
    mark = [F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")]
    now = store(links.select("a", "b").filter("a <> b").distinct())
    while True:
        after = store(_small_star(_large_star(now, store), store))
        if now.agg(*mark).first() == after.agg(*mark).first():
            own = after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return after.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(own)
        now = after
