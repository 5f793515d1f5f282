import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import history_state as H
from plumbline.operators import temporal as T

SCHEMA = ("lineage_id string, module string, metric_name string, target_type string, target_key string, run_id string, run_index int, "
          "metric_value double, severity string, higher_is_better boolean")


def observations(rng, runs):
    """Series of several shapes: ties, negative values, large values; one begins late, one pauses, one has a single point."""
    rows = []
    for i in range(runs):
        sev = lambda: rng.choice(["LOW", "LOW", "MEDIUM", "HIGH", "CRITICAL"])
        made = {"tied": rng.choice([0.0, -0.5, 0.25, 1.0]), "rise": i + rng.random(), "wide": rng.uniform(-1e12, 1e12), "small": rng.uniform(-3e-9, 3e-9),
                "step": (0.1 if i < runs // 2 else 0.4) + rng.random() / 100, "late": rng.random() if i >= 9 else None,
                "pause": rng.random() if i % 6 < 2 else None, "one": 5.0 if i == 4 else None}
        rows += [("L", "M", k, "FEATURE", f"FEATURE::{k}", f"r{i:03d}", i, v, sev(), k != "rise") for k, v in made.items() if v is not None]
    return rows


def table(df, keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def same(got, want, tolerance=1e-6):
    assert got.keys() == want.keys()
    for k in want:
        for name, value in want[k].items():
            if isinstance(value, float):
                assert got[k][name] == pytest.approx(value, rel=tolerance, abs=1e-8), (k, name)
            else:
                assert got[k][name] == value, (k, name)


def test_keys_keep_order_and_value(spark):
    rng = random.Random(4)
    values = [0.0, -0.0, 1.0, -1.0, 1e-9, -1e-9, 2.0, 0.5, 1.7e308, -1.7e308, 2.0**53, 2.0**52 - 1] + [2.0**k for k in range(-29, 60)]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 300) for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 9).alias("v"), H.ordered_key(F.col("v")).alias("k"))
    got = rows.withColumn("back", H.key_value(F.col("k"))).collect()
    assert all(r.back == r.v for r in got)
    ordered = sorted({(r.k, r.v + 0.0) for r in got})
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(ordered, ordered[1:]))


def test_appended_runs_equal_the_whole_history(spark, tmp_path):
    rows = observations(random.Random(7), 30)
    state, cuts = H.empty_history(spark), [0, 3, 4, 18, 30]
    for batch, (a, b) in enumerate(zip(cuts, cuts[1:]), 1):
        # Every batch sends the run before again.
        part = [r for r in rows if a - 1 <= r[6] < b]
        state = H.add_runs(state, spark.createDataFrame(part, SCHEMA).withColumn("batch", F.lit("clash")))
        state.save(str(tmp_path))
        state = H.load_history(spark, str(tmp_path), batch)
        if batch in (2, 4):
            whole = spark.createDataFrame([r for r in rows if r[6] < b], SCHEMA)
            for name in ("metric_history", "trend", "mann_kendall", "change_point"):
                same(table(getattr(state, name)(), T.SERIES), table(getattr(T, name)(whole), T.SERIES))
            same(table(state.persistence(), T.TARGET), table(T.persistence(T.target_runs(whole)), T.TARGET))
    assert state.splits.count() == len(rows)
    assert H.add_runs(state, spark.createDataFrame([], SCHEMA)).trend().count() == state.series.count()
