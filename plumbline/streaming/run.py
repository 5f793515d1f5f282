"""Run a stream over everything that is available, into a table under the session's checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def work_folder(spark: SparkSession, name: str) -> str:
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="plumbline-stream-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process all available input (append mode, exactly once into Parquet) and return the result table."""
    spark = stream.sparkSession
    folder = work_folder(spark, name)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        query = (
            stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True).start(f"{folder}/out")
        )
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
