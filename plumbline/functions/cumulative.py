"""Distributed running totals over sorted values.

ROC-AUC, average precision, KS, Wasserstein, Mann-Whitney and exact quantiles
all need "how much weight lies below this value". Rows are first collapsed to
one row per distinct value (map-side combined, so hot values are harmless).
The values of a key are then cut into slices at hash-sampled anchors; slice
totals give every slice its starting offset, and the window runs inside one
slice only. No task ever sorts a whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def melt(df: DataFrame, columns: dict[str, Column], keep: Sequence[Column | str] = ()) -> DataFrame:
    """One row per (input row, column): ``feature`` and ``value``."""
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), c.alias("value")) for n, c in columns.items()])
    return df.select(*keep, F.inline(cells))


def _position(anchors: Column, value: Column, slices: int) -> Column:
    """Number of anchors at or below ``value``, by binary search in a sorted array."""
    steps = []
    step = 1 << max(slices - 1, 1).bit_length()
    while step:
        steps.append(step)
        step >>= 1
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda pos, s: pos + F.when(F.get(anchors, pos + s - 1) <= value, s).otherwise(F.lit(0)),
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    weights: Sequence[str],
    slices: int = 256,
    bounded_keys: bool = True,
) -> DataFrame:
    """Add ``lt_<w>`` (total strictly before this row) and ``tot_<w>`` (total of the key).

    ``order`` must be unique within a key. ``bounded_keys`` says that the keys
    come from the schema (features), so the anchor table is small by
    construction; otherwise the join strategy is left to the size checks of
    the optimizer.
    """
    keys = list(keys)
    presence = None
    for w in weights:
        presence = F.col(w).isNotNull() if presence is None else presence | F.col(w).isNotNull()
    picked = (
        df.filter(presence)
        .groupBy(*keys, F.pmod(F.xxhash64(F.col(order)), F.lit(slices)).alias("_bucket"))
        .agg(F.min_by(order, F.xxhash64(F.col(order), F.lit(17))).alias("_anchor"))
    )
    anchors = picked.groupBy(*keys).agg(F.array_sort(F.collect_list("_anchor")).alias("_anchors"))
    if bounded_keys:
        hint, located = F.broadcast, df.join(F.broadcast(anchors), keys, "left")
    else:
        # The extra join column makes the aggregate's own partitioning useless for the join. Both
        # sides then arrive by plain exchanges, and AQE may split the rows of a hot key.
        hint, extra = (lambda d: d), F.xxhash64(*keys)
        located = df.withColumn("_key", extra).join(anchors.withColumn("_key", extra), ["_key", *keys], "left").drop("_key")
    sliced = located.withColumn("_slice", _position(F.col("_anchors"), F.col(order), slices)).drop("_anchors")
    totals = sliced.groupBy(*keys, "_slice").agg(*[F.sum(w).alias(f"_sum_{w}") for w in weights])
    over_slices = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_slice",
        *[F.coalesce(F.sum(f"_sum_{w}").over(over_slices), F.lit(0)).alias(f"_before_{w}") for w in weights],
        *[F.sum(f"_sum_{w}").over(Window.partitionBy(*keys)).alias(f"tot_{w}") for w in weights],
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = sliced.join(hint(offsets), [*keys, "_slice"], "left")
    return joined.select(
        *df.columns,
        *[
            (F.col(f"_before_{w}") + F.coalesce(F.sum(w).over(inside), F.lit(0))).alias(f"lt_{w}")
            for w in weights
        ],
        *[F.col(f"tot_{w}") for w in weights],
    )


def cumulative_counts(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weights: dict[str, Column],
    slices: int = 256,
    bounded_keys: bool = True,
) -> DataFrame:
    """Value-level table: keys, value, each weight, and its running totals."""
    counts = df.groupBy(*keys, value).agg(*[F.sum(c).alias(n) for n, c in weights.items()])
    return running_totals(counts, keys, value, list(weights), slices, bounded_keys)


def exact_quantiles(
    cumulative: DataFrame, keys: Sequence[str], value: str, weight: str, probs: dict[str, float]
) -> DataFrame:
    """Linear-interpolation quantiles per key, read off a cumulative table."""
    before, here, total = F.col(f"lt_{weight}"), F.col(weight), F.col(f"tot_{weight}")
    aggs, outs = [], []
    for name, q in probs.items():
        at = F.lit(float(q)) * (total - 1).cast("double")
        for side, k in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (before <= k) & (k < before + here)
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{side}"))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        pos = F.lit(float(q)) * (F.col("_n") - 1).cast("double")
        outs.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return (
        cumulative.filter(total > 0)
        .groupBy(*keys)
        .agg(F.max(total).alias("_n"), *aggs)
        .select(*keys, F.col("_n").alias("n"), *outs)
    )


def quantiles(df: DataFrame, columns: dict[str, Column], probs: dict[str, float], slices: int = 256) -> DataFrame:
    """Exact quantiles of many numeric columns: feature, n, one column per probability."""
    tall = melt(df, columns).filter(F.col("value").isNotNull())
    cumulative = cumulative_counts(tall, ["feature"], "value", {"n_rows": F.lit(1)}, slices)
    return exact_quantiles(cumulative, ["feature"], "value", "n_rows", probs)
