"""Column profiles that can be stored per partition and merged, so new data never needs old data again.

A partition leaves one row a column: exact counts and extremes, a HyperLogLog
sketch of its distinct values, a KLL sketch of its numbers and a summary of its
frequent values. All of them merge; profiles of any union of partitions are read
from the merged rows. The exact profile (``operators/quality.py``) stays the
default; this one is for tables that grow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, finite, is_numeric, missing
from ..functions.cumulative import melt

#: HyperLogLog with 2^12 registers: about 1.6 % standard error; KLL with k = 400: about 0.7 % of rank; values tracked as frequent.
LOG_K, KLL_K, TRACKED = 12, 400, 1000


def profile_sketches(df: DataFrame, columns: Sequence[str] | None = None, part: Column | None = None) -> DataFrame:
    """One row per column (and per value of ``part``): ``part, feature, n, missing, lo, hi, distinct, numbers, frequent``.

    Missing are nulls and NaN; numbers are the finite values of numeric columns.
    Every task folds its rows into sketches of fixed size before anything is shuffled.
    """
    names = list(columns) if columns is not None else df.columns
    cells = {c: F.struct(
        F.when(~missing(df, c), col(c).cast("string")).alias("text"), (finite(col(c)) if is_numeric(df, c) else F.lit(None).cast("double")).alias("number"),
    ) for c in names}
    tall = melt(df, cells, [(F.lit("all") if part is None else part.cast("string")).alias("part")])
    text, number = F.col("value.text"), F.col("value.number")
    tall = tall.select("part", "feature", text.alias("text"), number.alias("number"))
    return tall.groupBy("part", "feature").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").isNull()).alias("missing"), F.min("number").alias("lo"), F.max("number").alias("hi"),
        F.hll_sketch_agg("text", LOG_K).alias("distinct"), F.kll_sketch_agg_double("number", KLL_K).alias("numbers"),
        F.expr(f"approx_top_k_accumulate(text, {TRACKED})").alias("frequent"),
    )


def merge_profiles(sketches: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Sketch rows of several partitions as one row per key, with the same columns (``part`` becomes ``all`` if no key)."""
    out = sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("missing").alias("missing"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("numbers", KLL_K).alias("numbers"),
        F.expr(f"approx_top_k_combine(frequent, {TRACKED})").alias("frequent"),
    )
    return out if "part" in keys else out.withColumn("part", F.lit("all"))


def profile_estimates(merged: DataFrame, top: int = 5) -> DataFrame:
    """``feature, n, missing, lo, hi, distinct_estimate, q25, median, q75, outlier_rate, frequent``.

    ``outlier_rate`` is the share of numbers beyond 1.5 quartile ranges; both it
    and the quartiles are null without numbers. ``frequent`` are up to ``top``
    values with their estimated counts, missing ones aside.
    """
    numbers = F.col("numbers")
    held = F.kll_sketch_get_n_double(numbers) > 0
    at = lambda q: F.when(held, F.kll_sketch_get_quantile_double(numbers, F.lit(q)))
    out = merged.withColumns({"q25": at(0.25), "median": at(0.5), "q75": at(0.75)})
    spread = (F.col("q75") - F.col("q25")) * 1.5
    # The share beyond the fences, read off a grid of quantiles as fine as the sketch.
    ranks = F.array(*[F.lit((i + 0.5) / KLL_K) for i in range(KLL_K)])
    beyond = F.filter(F.kll_sketch_get_quantile_double(numbers, ranks), lambda v: (v < F.col("q25") - spread) | (v > F.col("q75") + spread))
    rate = F.when(held, F.size(beyond) / F.lit(float(KLL_K)))
    listed = F.filter(F.expr(f"approx_top_k_estimate(frequent, {top + 1})"), lambda x: x["item"].isNotNull())
    return out.select(
        "feature", "n", "missing", "lo", "hi", F.hll_sketch_estimate("distinct").alias("distinct_estimate"), "q25", "median", "q75",
        rate.alias("outlier_rate"), F.slice(listed, 1, top).alias("frequent"),
    )
