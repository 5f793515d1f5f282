from datetime import datetime, timedelta

from pyspark.sql import functions as F

from plumbline.streaming.labels import delayed_error_rates, labelled_stream
from plumbline.streaming.run import run_available

PREDICTIONS, LABELS = "id long, ts timestamp, predicted int", "id long, label_ts timestamp, label int"


def at(hours):
    return datetime(2024, 1, 1) + timedelta(hours=hours)


def test_late_labels_and_labels_that_never_come(spark, tmp_path):
    """Two files a side: labels arrive in a later batch than their predictions; 900 moves both watermarks on."""
    batches = [
        ([(1, at(0), 1), (2, at(1), 1), (3, at(2), 0), (4, at(3), 0)], [(1, at(5), 1)]),
        ([(900, at(500), 1)], [(2, at(30), 0), (3, at(51), 0), (900, at(500), 1), (77, at(9), 1)]),
    ]
    for i, (p, l) in enumerate(batches):
        spark.createDataFrame(p, PREDICTIONS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/p")
        spark.createDataFrame(l, LABELS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/l")
    read = lambda side, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{side}")
    joined = labelled_stream(read("p", PREDICTIONS), read("l", LABELS), "id", "ts", "label_ts", "label", "2 days", "1 day")
    rows = run_available(joined, "labels")
    assert {r.id: r.label for r in rows.collect()} == {1: 1, 2: 0, 3: None, 4: None, 900: 1} and rows.count() == 5
    first = delayed_error_rates(rows, "ts", "label", F.col("predicted")).orderBy("window_start").first()
    assert (first.n, first.labelled, first.errors, first.error_rate) == (4, 2, 1, 0.5)


def test_batch_tables_are_joined_alike(spark):
    p = spark.createDataFrame([(1, at(0), 1), (2, at(0), 0), (None, at(1), 1)], PREDICTIONS)
    l = spark.createDataFrame([(1, at(48), 0), (2, at(49), 0), (None, at(2), 1), (1, at(-1), 1)], LABELS)
    rows = labelled_stream(p, l, "id", "ts", "label_ts", "label", "2 days")
    assert {(r.id, r.label) for r in rows.collect()} == {(1, 0), (2, None), (None, None)}
    assert delayed_error_rates(rows.limit(0), "ts", "label", F.col("predicted")).count() == 0
