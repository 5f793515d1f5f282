"""Exact isotonic regression by pooling inside ordered slices and merging block lists.

Scores are collapsed to distinct values and cut into slices of equal length by
rank. Each slice pools its adjacent violators; what is left of it are blocks of
rising means. Pooling is associative: pooling the concatenated blocks of
neighbouring slices gives the blocks of both slices' points, so block lists are
merged ``FAN`` slices at a time until one list is left. Rows are shuffled once,
afterwards only blocks are. Means of 0/1 labels that rise are different
fractions whose denominators add up to the rows, so n rows leave at most about
n^(2/3) blocks for the last merge, and smooth curves some n^(1/3).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.cumulative import _position, cumulative_counts
from ..session import cut_lineage

SLICE = 50_000
FAN = 16
#: Blocks that are broadcast as one sorted array; more are looked up group by group.
LOOKUP = 100_000

_BLOCK = "slice long, lo double, hi double, weight double, total double"


def pool(blocks: Iterator[tuple[float, float, float, float]]) -> list[list[float]]:
    """Blocks (lo, hi, weight, total) in order, adjacent violators pooled; equal means are one block."""
    out: list[list[float]] = []
    for lo, hi, w, t in blocks:
        now = [lo, hi, w, t]
        while out and out[-1][3] * now[2] >= now[3] * out[-1][2]:
            last = out.pop()
            now = [last[0], now[1], last[2] + now[2], last[3] + now[3]]
        out.append(now)
    return out


def _pooled(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("lo")
    done = pool(zip(part["lo"].tolist(), part["hi"].tolist(), part["weight"].tolist(), part["total"].tolist()))
    out = pd.DataFrame(done, columns=["lo", "hi", "weight", "total"])
    out.insert(0, "slice", part["slice"].iloc[0])
    return out


def isotonic_blocks(df: DataFrame, y: str, p: str, slice_rows: int = SLICE, slices: int = 256) -> DataFrame:
    """``lo, hi, mean, weight``: the blocks of the rising step function of ``p`` nearest to ``y`` by squares.

    Rows with a null in either are left out; rows of equal ``p`` are one point.
    """
    rows = df.select(F.lit(0).alias("_all"), col(p).cast("double").alias("_x"), col(y).cast("double").alias("_y")).filter("_x IS NOT NULL AND _y IS NOT NULL")
    points = cumulative_counts(rows, ["_all"], "_x", {"w": F.lit(1), "t": F.col("_y")}, slices)
    cut = F.floor(F.col("lt_w") / F.lit(slice_rows))
    blocks = points.select(cut.alias("slice"), F.col("_x").alias("lo"), F.col("_x").alias("hi"), F.col("w").cast("double").alias("weight"), F.col("t").alias("total"))
    while True:
        blocks = cut_lineage(blocks.groupBy("slice").applyInPandas(_pooled, _BLOCK))
        if (blocks.agg(F.coalesce(F.max("slice"), F.lit(0))).first()[0]) == 0:
            break
        blocks = blocks.withColumn("slice", F.floor(F.col("slice") / FAN))
    return blocks.select("lo", "hi", (F.col("total") / F.col("weight")).alias("mean"), "weight")


def isotonic_apply(df: DataFrame, blocks: DataFrame, p: str, out: str, lookup: int = LOOKUP) -> DataFrame:
    """``df`` with ``out``: the mean of the block of ``p``; between blocks on the straight line, outside them the end's mean.

    Null scores stay null. Without blocks the result is null.
    """
    kept = [col(c) for c in df.columns if c != out]
    x = col(p).cast("double")
    blocks = cut_lineage(blocks)
    n = blocks.count()
    groups = max(1, -(-n // lookup))
    place = F.col("_b")
    found = lambda i: F.get("_blocks", i)
    between = found(place - 1)["mean"] + (found(place)["mean"] - found(place - 1)["mean"]) * (x - found(place - 1)["hi"]) / (found(place)["lo"] - found(place - 1)["hi"])
    value = (
        F.when(place == 0, found(F.lit(0))["mean"]).when(x <= found(place - 1)["hi"], found(place - 1)["mean"])
        .when(found(place).isNull(), found(place - 1)["mean"]).otherwise(between)
    )
    block = F.struct("lo", "hi", "mean")
    if groups == 1:
        whole = blocks.agg(F.array_sort(F.collect_list(block)).alias("_blocks"))
        rows = df.crossJoin(F.broadcast(whole))
    else:
        # Groups of neighbouring blocks; each also holds the first block of the next one, so lines between groups are known.
        starts = blocks.stat.approxQuantile("lo", [i / groups for i in range(1, groups)], 0.001 / groups)
        edges = F.array(*[F.lit(s) for s in sorted(set(starts))])
        group = lambda v: _position(edges, v, groups)
        homed = blocks.withColumn("_g", group(F.col("lo")))
        firsts = homed.groupBy("_g").agg(F.min_by(block, "lo").alias("b")).select((F.col("_g") - 1).alias("_g"), "b")
        lasts = homed.groupBy("_g").agg(F.max_by(block, "lo").alias("b")).select((F.col("_g") + 1).alias("_g"), "b")
        every = homed.select("_g", block.alias("b")).unionByName(firsts).unionByName(lasts)
        lists = cut_lineage(every.groupBy("_g").agg(F.array_sort(F.collect_set("b")).alias("_blocks")))
        rows = df.withColumn("_g", group(x)).join(lists, "_g", "left")
    width = 2 * max(n, 2)
    rows = rows.withColumn("_b", _position(F.transform("_blocks", lambda b: b["lo"]), x, width))
    return rows.select(*kept, F.when(x.isNotNull(), value).alias(out))
