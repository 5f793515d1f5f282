"""Contingency tables, correlation measures and false-discovery control."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp, col, finite, missing, ratio
from ..functions.cumulative import melt, quantiles


def text_cells(df: DataFrame, names: Sequence[str]) -> dict[str, Column]:
    return {c: F.when(~missing(df, c), col(c).cast("string")) for c in names}


def contingency(df: DataFrame, a: dict[str, Column], b: Column) -> DataFrame:
    """feature, a, b, n with both marginals and the total. Marginals come from joins on
    aggregated cells, so a frequent level is never gathered in one window."""
    cells = (
        melt(df, a, [b.alias("b")])
        .filter(F.col("value").isNotNull() & F.col("b").isNotNull())
        .groupBy("feature", F.col("value").alias("a"), "b")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rows = cells.groupBy("feature", "a").agg(F.sum("n").alias("n_a"))
    columns = cells.groupBy("feature", "b").agg(F.sum("n").alias("n_b"))
    whole = cells.groupBy("feature").agg(F.sum("n").alias("n_all"))
    # A class has a cell for every level of a feature. With the extra join column both sides arrive
    # by plain exchanges (the aggregate's own partitioning doesn't do), so AQE may split a large class.
    key = F.xxhash64("feature", "b")
    both = cells.join(rows, ["feature", "a"]).withColumn("_key", key)
    return both.join(columns.withColumn("_key", key), ["_key", "feature", "b"]).drop("_key").join(F.broadcast(whole), "feature")


def _cell_stats(table: DataFrame) -> DataFrame:
    """Per feature: n, levels of both sides, chi-square without correction, mutual information.

    Empty cells add their expected count to chi-square; since all expected
    counts sum to n, that part is n minus the expected counts of filled cells.
    """
    expected = F.col("n_a") * F.col("n_b") / F.col("n_all")
    n = F.col("n").cast("double")
    return table.groupBy("feature").agg(
        F.max("n_all").alias("n"),
        F.sum(F.lit(1.0) * F.col("n") / F.col("n_a")).alias("_levels_a"),
        F.sum(F.lit(1.0) * F.col("n") / F.col("n_b")).alias("_levels_b"),
        (F.sum((n - expected) * (n - expected) / expected) + F.max("n_all") - F.sum(expected)).alias("chi2"),
        F.sum(n / F.col("n_all") * F.log(n * F.col("n_all") / (F.col("n_a") * F.col("n_b")))).alias("mi"),
    ).select(
        "feature",
        "n",
        F.round("_levels_a").cast("long").alias("levels_a"),
        F.round("_levels_b").cast("long").alias("levels_b"),
        F.greatest(F.col("chi2"), F.lit(0.0)).alias("chi2"),
        F.greatest(F.col("mi"), F.lit(0.0)).alias("mi"),
    )


def cramers_v_of(table: DataFrame) -> DataFrame:
    s = _cell_stats(table)
    smaller = F.least("levels_a", "levels_b") - 1
    v = F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * smaller))
    return s.select(
        "feature", "n", F.when(smaller < 1, F.lit(0.0)).otherwise(clamp(F.coalesce(v, F.lit(0.0)), 0, 1)).alias("cramers_v")
    )


def cramers_v(df: DataFrame, columns: Sequence[str], other: str | Column) -> DataFrame:
    """Cramer's V of each column against one other column (no continuity correction)."""
    b = col(other).cast("string") if isinstance(other, str) else other.cast("string")
    return cramers_v_of(contingency(df, text_cells(df, columns), b))


def pearson(df: DataFrame, columns: Sequence[str], y: Column) -> DataFrame:
    """Pearson r of every column with ``y`` over complete finite pairs; NULL under five pairs or without spread."""
    y = finite(y)
    aggs, cells = [], []
    for i, c in enumerate(columns):
        x = F.when(y.isNotNull(), finite(col(c)))
        pair_y = F.when(x.isNotNull(), y)
        aggs += [F.count(x).alias(f"_n{i}"), F.corr(x, pair_y).alias(f"_r{i}"),
                 (F.min(x) < F.max(x)).alias(f"_x{i}"), (F.min(pair_y) < F.max(pair_y)).alias(f"_y{i}")]
        ok = (F.col(f"_n{i}") >= 5) & F.col(f"_x{i}") & F.col(f"_y{i}")
        cells.append(F.struct(F.lit(c).alias("feature"), F.col(f"_n{i}").alias("n"), F.when(ok, F.col(f"_r{i}")).alias("r")))
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def correlation_ratio(df: DataFrame, groups: dict[str, Column], numbers: dict[str, Column]) -> DataFrame:
    """Correlation ratio of (group column, number column) pairs that share a name.

    Two-level sums: per (feature, group), then per feature.
    """
    cells = F.array(
        *[F.struct(F.lit(k).alias("feature"), g.cast("string").alias("g"), numbers[k].alias("x")) for k, g in groups.items()]
    )
    tall = df.select(F.inline(cells)).filter(F.col("g").isNotNull() & F.col("x").isNotNull())
    per = tall.groupBy("feature", "g").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var")
    )
    whole = per.groupBy("feature").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("n_groups"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"),
        F.sum(F.col("n") * F.col("var")).alias("within"),
    )
    between = per.join(F.broadcast(whole.select("feature", "grand")), "feature").groupBy("feature").agg(
        F.sum(F.col("n") * (F.col("mean") - F.col("grand")) * (F.col("mean") - F.col("grand"))).alias("between")
    )
    eta = F.sqrt(F.try_divide(F.col("between"), F.col("between") + F.col("within")))
    ok = (F.col("n") >= 5) & (F.col("n_groups") >= 2)
    return whole.join(F.broadcast(between), "feature").select(
        "feature", "n", F.when(ok, F.coalesce(eta, F.lit(0.0))).otherwise(F.lit(0.0)).alias("eta")
    )


def quantile_codes(df: DataFrame, columns: Sequence[str], bins: int, slices: int = 256) -> dict[str, Column]:
    """Bin number of each numeric column at its own exact quantiles.

    The edges (columns x bins numbers) are the only thing that passes through the driver.
    """
    probs = {f"e{i}": i / bins for i in range(1, bins)}
    rows = quantiles(df, {c: finite(col(c)) for c in columns}, probs, slices).collect()
    edges = {r["feature"]: sorted({r[k] for k in probs if r[k] is not None}) for r in rows}
    out = {}
    for c in columns:
        x = finite(col(c))
        code = F.lit(0)
        for e in edges.get(c, []):
            code = code + F.when(x >= e, 1).otherwise(0)
        out[c] = F.when(x.isNotNull(), code).cast("string")
    return out


def mutual_information(
    df: DataFrame,
    columns: Sequence[str],
    y: Column,
    bins: int = 20,
    discrete_limit: int = 10,
    slices: int = 256,
) -> DataFrame:
    """Plug-in mutual information in nats.

    Text, boolean and low-cardinality integer columns enter as they are; other
    numeric columns are cut at exact quantiles (missing values form a level).
    """
    from pyspark.sql import types as T

    from .quality import distinct_counts

    numbers = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    whole = [c for c in numbers if isinstance(df.schema[c].dataType, T.IntegralType)]
    few = set()
    if whole:
        few = {r["feature"] for r in distinct_counts(df, whole).filter(F.col("distinct_count") <= discrete_limit).collect()}
    binned = [c for c in numbers if c not in few]
    cells = text_cells(df, [c for c in columns if c not in binned])
    if binned:
        cells |= quantile_codes(df, binned, bins, slices)
    cells = {c: F.coalesce(cells[c], F.lit("missing")) for c in columns}
    return _cell_stats(contingency(df, cells, y.cast("string"))).select("feature", "n", "mi")


def fdr(df: DataFrame, p: str, family: Sequence[str], tie: str, out: str = "p_adjusted") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values within each family (result tables: one row per feature)."""
    order = Window.partitionBy(*family).orderBy(p, tie)
    size = F.count(p).over(Window.partitionBy(*family))
    scaled = df.withColumn("_scaled", F.col(p) * size / F.row_number().over(order))
    back = Window.partitionBy(*family).orderBy(F.desc(p), F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
    return scaled.withColumn(out, F.least(F.min("_scaled").over(back), F.lit(1.0))).drop("_scaled")
