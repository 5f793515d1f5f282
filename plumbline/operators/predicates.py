"""Filters and column-role resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, count_if, digest_uniform, finite, missing, numeric_columns, ratio

# Column names tried in order.
PREDICTION_COLUMNS = ["pred_prob", "prediction", "probability", "score", "pred", "y_pred_prob", "y_score"]
PROTECTED_COLUMNS = ["is_foreign_ip", "card_network", "gender", "age_group", "protected_class", "race", "ethnicity"]
# Fixed values: (negative, positive) label pairs.
LABEL_PAIRS = [("0", "1"), ("0.0", "1.0"), ("false", "true"), ("n", "y"), ("no", "yes"), ("negative", "positive")]


def resolve_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate present in the schema."""
    return next((c for c in candidates if c in df.columns), None)


def numeric_features(df: DataFrame, exclude: Sequence[str] = (), cap: int | None = None) -> list[str]:
    """Numeric columns that can be perturbed or compared, in schema order; all of them unless the caller sets ``cap``."""
    names = numeric_columns(df, exclude)
    return names if cap is None else names[:cap]


def valid_prediction(p: Column) -> Column:
    """Finite and inside [0, 1]."""
    d = finite(p)
    return F.coalesce(d.between(0.0, 1.0), F.lit(False))


def valid_pairs(df: DataFrame, y: str, p: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rows with a label and a usable probability, the probability as a double."""
    return df.filter(~missing(df, y) & valid_prediction(col(p))).withColumn(p, col(p).cast("double"))


def valid_pair_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    label = ~missing(df, y)
    good = valid_prediction(col(p))
    out = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~good).alias("invalid_predictions"),
        F.count_if(label & good).alias("valid_rows"),
    )
    return out.withColumn("invalid_rate", ratio(F.col("invalid_predictions"), F.col("n_rows"), 0))


def fairness_rows(df: DataFrame, y: str, attr: str, p: str) -> DataFrame:
    return df.filter(~missing(df, y) & ~missing(df, attr) & ~missing(df, p))


def fairness_row_counts(df: DataFrame, y: str, attr: str, p: str) -> DataFrame:
    keep = ~missing(df, y) & ~missing(df, attr) & ~missing(df, p)
    out = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(keep).alias("kept_rows"))
    gone = F.col("n_rows") - F.col("kept_rows")
    return out.select("n_rows", "kept_rows", gone.alias("excluded_rows"), ratio(gone, F.col("n_rows"), 0).alias("excluded_rate"))


def label_classes(df: DataFrame, y: str) -> list[str]:
    """At most three distinct labels, as text in order: enough to tell one, two or many classes."""
    text = df.filter(~missing(df, y)).select(col(y).cast("string").alias("v")).distinct()
    return sorted(r[0] for r in text.limit(3).collect())


def map_binary(df: DataFrame, y: str, positive: str | None = None, out: str = "y") -> DataFrame:
    """Add a 0/1 label. More than two classes is an error; a single class is kept as it is."""
    classes = label_classes(df, y)
    if len(classes) > 2:
        raise ValueError(f"label {y!r} has more than two classes")
    if positive is None:
        lowered = [c.lower() for c in classes]
        for negative, pos in LABEL_PAIRS:
            if lowered and set(lowered) <= {negative, pos}:
                positive = classes[lowered.index(pos)] if pos in lowered else pos
                break
        else:
            positive = classes[-1] if len(classes) == 2 else None
    text = col(y).cast("string")
    hit = F.lit(0) if positive is None else (text == F.lit(str(positive))).cast("int")
    return df.withColumn(out, F.when(~missing(df, y), hit))


def baseline_runs(runs: DataFrame) -> DataFrame:
    """Operational history leaves experiments out."""
    return runs.filter(F.coalesce(F.col("run_type"), F.lit("BASELINE")) != "EXPERIMENT")


def last_n_runs(runs: DataFrame, n: int | None, lineage: str = "lineage_id", order: str = "run_index") -> DataFrame:
    """Newest ``n`` runs of every lineage; all of them when ``n`` is None.

    The rank filter becomes a partial top-k before the shuffle, so a lineage
    with a huge history never sits in one sort.
    """
    if n is None:
        return runs
    newest = Window.partitionBy(lineage).orderBy(F.desc(order))
    ranked = runs.select(lineage, order).distinct().withColumn("_r", F.row_number().over(newest))
    return runs.join(ranked.filter(F.col("_r") <= n).drop("_r"), [lineage, order], "left_semi")


def seeded_sample(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """Fixed-size random rows that do not depend on partitioning: smallest digests of seed and key."""
    picked = [col(k) for k in keys] or [col(c) for c in df.columns]
    return df.orderBy(digest_uniform(seed, *picked), *picked).limit(n)
