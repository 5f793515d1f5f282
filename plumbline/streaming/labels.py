"""Predictions joined with labels that arrive later.

Both sides are streams. A prediction waits for its label for ``within`` of event
time; watermarks on both sides bound the state to that span. A prediction whose
label never comes in time is passed on without one once the watermark is past
its wait, so that every prediction is counted exactly once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio


def labelled_stream(predictions: DataFrame, labels: DataFrame, key: str, ts: str, label_ts: str, label: str, within: str = "7 days",
                    watermark: str = "1 day") -> DataFrame:
    """The columns of ``predictions`` with ``label`` and ``label_ts``, null where no label came within ``within`` of ``ts``.

    ``key`` tells predictions apart on both sides. A label at the same time or
    later counts, up to and with ``within``; a second label of a prediction gives
    a second row. Rows behind the watermark of their side are dropped as late.
    Predictions without a label appear when both sides have moved on by
    ``within`` and ``watermark``; with a batch table on both sides at once.
    """
    p = predictions.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    l = labels.select(F.col(key).alias("_key"), F.col(label_ts).cast("timestamp").alias(label_ts), F.col(label).alias(label)).withWatermark(label_ts, watermark)
    limit = F.col(ts) + F.expr(f"INTERVAL {within}")
    same = (F.col(key) == F.col("_key")) & (F.col(label_ts) >= F.col(ts)) & (F.col(label_ts) <= limit)
    return p.join(l, same, "left_outer").drop("_key")


def delayed_error_rates(joined: DataFrame, ts: str, label: str, predicted: Column, window: str = "1 day", keys: Sequence[str] = ()) -> DataFrame:
    """Per window of prediction time: predictions, those labelled, errors among these and their rate (null without a label)."""
    seen, wrong = F.col(label).isNotNull(), F.col(label) != predicted
    out = joined.groupBy(F.window(ts, window).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(seen).alias("labelled"), F.count_if(F.coalesce(wrong, F.lit(False))).alias("errors"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "labelled", "errors",
                      ratio(F.col("errors"), F.col("labelled")).alias("error_rate"))
