"""Uniform shuffle into shards of exact size, through a hypergeometric communication matrix.

Rows are dealt to partitions. How many rows each partition sends to each shard
is drawn from the multivariate hypergeometric law, so every assignment of rows
to shards with the wanted sizes is equally likely. Each partition permutes its
rows and sends the first ones to shard 0, the next to shard 1 and so on; each
shard permutes again. Only counts (partitions x shards) pass through the driver.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.storage import stored

ROWS_PER_PARTITION = 250_000
PARTITIONS = 64  # at least


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` out of ``good + bad``, by inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p0 = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u = rng.random() - p0
    if u < 0:
        return mode
    up, down, k_up, k_down = p0, p0, mode, mode
    while True:
        moved = False
        if k_up < high:
            up *= (good - k_up) * (draws - k_up) / ((k_up + 1) * (bad - draws + k_up + 1))
            k_up += 1
            moved = up > 0
            u -= up
            if u < 0:
                return k_up
        if k_down > low:
            down *= k_down * (bad - draws + k_down) / ((good - k_down + 1) * (draws - k_down + 1))
            k_down -= 1
            moved = moved or down > 0
            u -= down
            if u < 0:
                return k_down
        if not moved:  # what rounding has left of the total
            return mode


def communication_matrix(rng: random.Random, rows: list[int], shards: list[int]) -> list[list[int]]:
    """Counts with the row sums ``rows`` and the column sums ``shards``, drawn as a uniform shuffle makes them."""
    left = list(shards)
    out = []
    for n in rows:
        total, need, line = sum(left), n, []
        for s, size in enumerate(left):
            k = hypergeometric(rng, size, total - size, need)
            line.append(k)
            total, need, left[s] = total - size, need - k, size - k
        out.append(line)
    return out


def shard_sizes(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def uniform_shards(rows: DataFrame, shards: int, seed: int = 42, rows_per_partition: int = ROWS_PER_PARTITION, partitions: int = PARTITIONS) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards-1, counts at most one apart) and ``slot`` (0, 1, ... in each shard).

    Repeated rows and null values are placed like any other; an empty table
    gives an empty result. Columns named shard or slot are replaced.
    """
    keep = [c for c in rows.columns if c not in ("shard", "slot") and not c.startswith("_")]
    rid = F.monotonically_increasing_id()
    base = stored(rows.select(*[F.col(f"`{c}`") for c in keep], rid.alias("_rid")))
    total = base.count()
    parts = max(partitions, math.ceil(total / rows_per_partition))
    key = lambda n: F.xxhash64(F.lit(seed), F.lit(n), F.col("_rid"))
    base = base.withColumn("_part", F.pmod(key(0), F.lit(parts)).cast("int"))
    counts = dict(base.groupBy("_part").count().collect())  # one number per partition
    matrix = communication_matrix(random.Random(seed), [counts.get(p, 0) for p in range(parts)], shard_sizes(total, shards))
    cells = [(p, s, k) for p, line in enumerate(matrix) for s, k in enumerate(line)]
    ends = rows.sparkSession.createDataFrame(cells, "_part int, s int, k long")
    # Running ends of the shards inside each partition's permuted order.
    by_part = Window.partitionBy("_part").orderBy("s")
    ends = ends.withColumn("e", F.sum("k").over(by_part)).groupBy("_part").agg(F.sort_array(F.collect_list("e")).alias("_ends"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(key(1), "_rid")) - 1
    sent = base.withColumn("_at", local).join(ends, "_part").withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_at"))))
    sent = stored(sent.drop("_ends", "_at", "_part"))
    # The second permutation: by hash, a shard is cut into hash ranges that are ordered apart.
    ranges = max(1, math.ceil(total / shards / rows_per_partition))
    again = key(2)
    sent = sent.withColumn("_range", F.floor((again / F.lit(2.0 ** 64) + 0.5) * ranges).cast("int")).withColumn("_key", again)
    sizes = sent.groupBy("shard", "_range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("shard", "_range").orderBy("_key", "_rid")) - 1
    placed = sent.withColumn("_nth", nth).join(starts, ["shard", "_range"])
    return placed.select(*keep, F.col("shard").cast("int").alias("shard"), (F.col("_start") + F.col("_nth")).cast("long").alias("slot"))
