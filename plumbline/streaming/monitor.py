"""Windowed monitoring metrics on a scored stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..operators.performance import bucket, grid

EPSILON = 1e-4


def monitor_stream(
    stream: DataFrame,
    ts: str,
    y: Column,
    p: Column,
    window: str = "1 day",
    slide: str | None = None,
    watermark: str = "1 day",
    keys: Sequence[str] = (),
    bins: int = 10,
    baseline_shares: Sequence[float] | None = None,
    threshold: float = 0.5,
) -> DataFrame:
    """Error rate, calibration error and PSI of the score per event-time window (append mode).

    Late rows are dropped by the watermark. The state per window and key is a fixed
    number of sums. ``baseline_shares`` are the score shares per bin of the baseline.
    """
    edges = grid(bins + 1)
    rows = stream.select(F.col(ts).cast("timestamp").alias("_ts"), *keys, y.cast("int").alias("_y"), p.cast("double").alias("_p")).filter(
        F.col("_p").between(0.0, 1.0) & F.col("_y").isNotNull())
    rows = rows.withColumn("_b", F.least(bucket(F.col("_p"), edges), F.lit(bins)) - 1).withWatermark("_ts", watermark)
    b, wrong = F.col("_b"), (F.col("_p") >= threshold).cast("int") != F.col("_y")
    span = F.window("_ts", window, slide) if slide else F.window("_ts", window)
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("errors"), F.avg("_p").alias("mean_p"), F.avg(F.col("_y").cast("double")).alias("positive_rate")]
    for i in range(bins):
        aggs += [F.count_if(b == i).alias(f"_n{i}"), F.sum(F.when(b == i, F.col("_p") - F.col("_y")).otherwise(F.lit(0.0))).alias(f"_g{i}")]
    out = rows.groupBy(span.alias("w"), *keys).agg(*aggs)
    n = F.col("n").cast("double")
    ece = sum((F.abs(F.col(f"_g{i}")) for i in range(bins)), F.lit(0.0)) / n
    shown = [F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "errors", ratio(F.col("errors"), F.col("n"), 0).alias("error_rate"),
             "mean_p", "positive_rate", ece.alias("ece")]
    if baseline_shares is not None:
        psi = F.lit(0.0)
        for i, share in enumerate(baseline_shares):
            expected = (share + EPSILON) / (1 + EPSILON * bins)
            actual = (F.col(f"_n{i}") + EPSILON) / (n + EPSILON * bins)
            psi = psi + (actual - expected) * F.log(actual / expected)
        shown.append(psi.alias("psi"))
    return out.select(*shown)


def score_shares(df: DataFrame, p: Column, bins: int = 10) -> list[float]:
    """Share of a baseline table per score bin (``bins`` numbers)."""
    b = F.least(bucket(p.cast("double"), grid(bins + 1)), F.lit(bins)) - 1
    counts = {r["b"]: r["n"] for r in df.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values()) or 1
    return [counts.get(i, 0) / total for i in range(bins)]
