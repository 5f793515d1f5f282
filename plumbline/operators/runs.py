"""Run status, staleness and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio


def run_status(modules: DataFrame) -> DataFrame:
    """COMPLETED, FAILED or PARTIAL once every module ended; RUNNING or PENDING before."""
    s = F.col("status")
    out = modules.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("modules"),
        F.count_if(s == "COMPLETED").alias("completed"),
        F.count_if(s == "FAILED").alias("failed"),
        F.count_if(s == "SKIPPED").alias("skipped"),
        F.count_if(s == "RUNNING").alias("running"),
    )
    n, done, bad, skipped = F.col("modules"), F.col("completed"), F.col("failed"), F.col("skipped")
    return out.withColumn(
        "status",
        F.when(done + skipped == n, F.lit("COMPLETED"))
        .when(bad + skipped == n, F.lit("FAILED"))
        .when(done + bad + skipped == n, F.lit("PARTIAL"))
        .when((F.col("running") > 0) | (done + bad > 0), F.lit("RUNNING"))
        .otherwise(F.lit("PENDING")),
    )


def stale_runs(runs: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """Running since before the cutoff."""
    cutoff = now - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    return runs.filter((F.col("status") == "RUNNING") & (F.col("started_at") < cutoff))


def run_progress(runs: DataFrame, modules: DataFrame) -> DataFrame:
    """Module counts and percent done; a finished run shows 100."""
    per = run_status(modules).drop("status")
    ended = F.col("completed") + F.col("failed") + F.col("skipped")
    finished = F.col("status").isin("COMPLETED", "FAILED", "PARTIAL", "CANCELLED")
    percent = F.when(finished, F.lit(100.0)).otherwise(F.round(ratio(ended * 100, F.col("modules"), 0), 1))
    return runs.select("run_id", "status").join(per, "run_id", "left").fillna(0).withColumn("percent", percent)
