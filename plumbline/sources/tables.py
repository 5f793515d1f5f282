"""Table input and idempotent result output."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _strip(uri: str) -> str:
    return uri[len("file://"):] if uri.startswith("file://") else uri


def load_table(spark: SparkSession, uri: str, schema: str | None = None) -> DataFrame:
    """Read a table by extension. A missing path raises at once; unknown extensions are read as CSV, then Parquet.

    Give ``schema`` for large text tables, inference costs an extra pass.
    """
    path = _strip(uri)
    name = path.rstrip("/").lower()
    reader = spark.read if schema is None else spark.read.schema(schema)

    def csv() -> DataFrame:
        return reader.csv(path, header=True, inferSchema=schema is None)

    if name.endswith((".parquet", ".pq")):
        return reader.parquet(path)
    if name.endswith((".csv", ".txt", ".csv.gz")):
        return csv()
    if name.endswith((".jsonl", ".ndjson")):
        return reader.json(path)
    if name.endswith(".json"):
        # An array of objects spans lines; columns are discovered over all objects.
        return reader.json(path, multiLine=True)
    try:
        # Reads a footer if there is one; nothing else of the file.
        spark.read.parquet(path)
    except Exception as error:  # noqa: BLE001 - no footer, or no such path
        if "PATH_NOT_FOUND" in str(error):
            raise
        return csv()
    return reader.parquet(path)


def load_pair(spark: SparkSession, evaluation: str, baseline: str | None = None) -> tuple[DataFrame, DataFrame | None, str | None]:
    """Evaluation table, optional baseline, and the reason why the baseline is absent.

    A bad evaluation table raises; a bad baseline only leaves the modules that need it out.
    """
    ev = load_table(spark, evaluation)
    if baseline is None:
        return ev, None, None
    try:
        return ev, load_table(spark, baseline), None
    except Exception as error:  # noqa: BLE001 - any read problem means "no baseline"
        return ev, None, str(error).split("\n")[0]


def side_by_side(evaluation: DataFrame, baseline: DataFrame) -> DataFrame:
    """Both tables in one, told apart by ``side``; columns missing on a side are NULL."""
    return evaluation.withColumn("side", F.lit("eval")).unionByName(
        baseline.withColumn("side", F.lit("base")), allowMissingColumns=True
    )


def write_candidate(df: DataFrame, folder: str, name: str, provenance: dict[str, str], fmt: str = "parquet") -> str:
    """Write a transformed table next to its source, the provenance as constant columns of a side table."""
    path = f"{folder.rstrip('/')}/{name}.{fmt}"
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)
    note = df.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in provenance.items()], F.lit(path).alias("path"))
    note.write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}.provenance")
    return path


def write_partition(df: DataFrame, path: str, keys: Sequence[str] = ("run_id",), replaces: Sequence[str] | None = None) -> None:
    """Replace the partitions of a rerun, so that it leaves one copy.

    With ``replaces``, the values of the single key that this execution stands
    for, every one of these partitions is rewritten, to an empty one where the
    execution found nothing. Without it only partitions present in ``df`` are replaced.
    """
    if replaces is None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
        return
    (key,) = keys
    for value in replaces:
        rows = df.filter(F.col(key) == F.lit(value)).drop(key)
        rows.write.mode("overwrite").parquet(f"{path}/{key}={quote(str(value), safe=' -_.~')}")
