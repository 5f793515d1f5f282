"""Row numbers inside keys of any size, without one task seeing a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.storage import stored


def numbered(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``pos``, the place from 0 of a row among the rows of its ``key`` in the given order.

    Rows are dealt to partitions by ranges of key, order and place in the input,
    and sorted there; a key's places start where its rows in earlier partitions
    end. Rows that are equal in all of ``order`` may change places with each other.
    """
    placed = rows.withColumn("__at", F.monotonically_increasing_id())
    by = [F.col(f"`{key}`").asc_nulls_first(), *order, F.col("__at").asc()]
    laid = placed.repartitionByRange(*by).sortWithinPartitions(*by).drop("__at")
    laid = stored(laid.withColumn("__part", F.spark_partition_id()).withColumn("__n", F.monotonically_increasing_id()))
    starts = laid.groupBy(key, "__part").agg(F.min("__n").alias("__first"), F.count("*").alias("__rows"))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(starts.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0))).withColumnsRenamed({key: "__key", "__part": "__in"}))
    same = (F.col("__part") == F.col("__in")) & F.col(f"`{key}`").eqNullSafe(F.col("__key"))
    return laid.join(starts, same).withColumn("pos", F.col("__n") - F.col("__first") + F.col("__before")).select(*[F.col(f"`{c}`") for c in rows.columns], "pos")
