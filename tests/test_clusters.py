import random

from pyspark.sql import functions as F

from plumbline.operators import clusters as C
from plumbline.operators import incidents as I

SCHEMA = "lineage_id string, alert_id string, target_key string, investigation string, track long, first_run string, source_module string, metric_name string, last_run string"


def made(rng, n):
    return [(
        f"L{rng.randrange(2)}", f"{rng.randrange(10**6):06d}", rng.choice(["GLOBAL", None, f"FEATURE::{rng.randrange(n // 3)}", f"FEATURE::{rng.randrange(n // 3)}"]),
        f"i{rng.randrange(n)}" if rng.random() < 0.3 else None, rng.randrange(n) if rng.random() < 0.2 else None,
        f"r{rng.randrange(4)}", rng.choice(["DRIFT", "ERROR"]), f"m{rng.randrange(2)}", f"r{rng.randrange(3)}" if rng.random() < 0.9 else None,
    ) for _ in range(n)]


def keys(df):
    return {r.alert_id: r.incident_key for r in df.collect()}


def test_batches_give_the_clusters_of_one_run(spark, tmp_path):
    rows = made(random.Random(1), 90)
    whole = keys(I.incident_clusters(spark.createDataFrame(rows, SCHEMA)))
    state, seen, before = C.empty_clusters(spark), [], {}
    for batch, size in enumerate([40, 1, 49], 1):
        part = rows[len(seen):len(seen) + size]
        seen += part
        state = C.add_alerts(state, spark.createDataFrame(part + seen[:2], SCHEMA))
        state.save(str(tmp_path))
        state = C.load_clusters(spark, str(tmp_path), batch)
        now = keys(state.clusters())
        merges = state.merges.filter(F.col("batch") == batch).collect()
        groups = {}
        for a, k in before.items():
            groups.setdefault(now[a], set()).add(k)
        assert len(merges) == sum(len(g) - 1 for g in groups.values())
        assert all(m.from_key in groups[m.into_key] for m in merges)
        before = now
    assert before == whole


def test_a_global_alert_wakes_waiting_context(spark):
    alert = lambda i, target: ("L", i, target, None, None, "r1", "DRIFT", "m", "r2")
    state = C.add_alerts(C.empty_clusters(spark), spark.createDataFrame([alert("b", "FEATURE::x"), alert("c", "FEATURE::y")], SCHEMA))
    assert keys(state.clusters()) == {"b": "b", "c": "c"} and state.waiting.count() == 2
    state = C.add_alerts(state, spark.createDataFrame([alert("a", "GLOBAL")], SCHEMA))
    assert keys(state.clusters()) == {"a": "a", "b": "a", "c": "a"} and state.waiting.count() == 0
    assert {(m.from_key, m.into_key) for m in state.merges.collect()} <= {("b", "a"), ("c", "a")} and state.merges.count() == 1
    assert C.add_alerts(state, spark.createDataFrame([], SCHEMA)).clusters().count() == 3
