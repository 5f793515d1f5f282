"""Trends, lifecycles, clusters and trajectories against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.operators import incidents as I
from plumbline.operators import lifecycle as L
from plumbline.operators import reliability as R
from plumbline.operators import temporal as T
from plumbline.sources.tables import load_table
from plumbline.streaming.alerts import alert_stream
from plumbline.streaming.run import run_available

SCHEMA = "lineage_id string, module string, metric_name string, target_type string, target_key string, run_id string, run_index int, metric_value double"


def series(spark, **values):
    rows = [(k, "M", "m", "GLOBAL", "GLOBAL", f"{k}{i}", i, float(v)) for k, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_mann_kendall(spark):
    obs = series(spark, up=[0.1, 0.2, 0.3, 0.4, 0.5, 0.6], down=[0.9, 0.8, 0.7, 0.6, 0.5, 0.4], few=[1, 2, 3])
    got = {r["lineage_id"]: r for r in T.mann_kendall(obs).collect()}
    assert got["up"]["tau"] > 0.9 and got["up"]["trend"] == "INCREASING"
    assert got["down"]["tau"] < -0.9 and got["down"]["trend"] == "DECREASING"
    assert got["few"]["trend"] == "INSUFFICIENT_DATA"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mann_kendall_counts_every_pair(spark, seed):
    random.seed(seed)
    vs = [random.choice([1, 2, 3, 4, 5, random.random()]) for _ in range(67)]
    s = sum((b > a) - (b < a) for i, a in enumerate(vs) for b in vs[i + 1:])
    assert T.mann_kendall(series(spark, x=vs)).first()["s"] == s


def test_trend_and_change_point(spark):
    obs = series(spark, a=[0.88, 0.86, 0.84, 0.81, 0.78, 0.75]).withColumn("higher_is_better", F.lit(True))
    assert T.trend(obs).first()["direction"] == "DEGRADING"
    low = series(spark, a=[0.04, 0.08, 0.14, 0.22, 0.31]).withColumn("higher_is_better", F.lit(False))
    assert T.trend(low).first()["direction"] == "DEGRADING"
    cp = T.change_point(series(spark, a=[0.02, 0.03, 0.02, 0.03, 0.18, 0.20, 0.19, 0.21])).first()
    assert cp["change_index"] == 4 and cp["before_mean"] < 0.05 and cp["after_mean"] > 0.15


def test_lag_correlation(spark):
    a, b = series(spark, x=[0.1, 0.3, 0.2, 0.5, 0.4, 0.7]), series(spark, x=[0.0, 0.1, 0.3, 0.2, 0.5, 0.4])
    best = T.lag_correlation(a, b).orderBy(F.desc("r")).first()
    assert best["lag"] == 1 and best["r"] == pytest.approx(1.0)


@pytest.mark.parametrize("ranks,status", [
    ([0, 2, 3], "ESCALATING"), ([3, 2, 0], "DEESCALATING"), ([0, 3, 0, 0], "RECOVERED"), ([0, 3, 0], "TRANSIENT"),
    ([0, 2, 2, 2], "PERSISTENT"), ([2, 0, 2], "RECURRING"), ([0, 0, 2], "EMERGING"), ([0, 0, 0], "TRANSIENT"),
])
def test_persistence(spark, ranks, status):
    rows = [("l", "FEATURE", "k", i, r) for i, r in enumerate(ranks)]
    seq = spark.createDataFrame(rows, "lineage_id string, target_type string, target_key string, run_index int, rank int")
    assert T.persistence(seq).first()["status"] == status


def test_actions_are_replayed_over_chunks(spark):
    random.seed(9)
    names = list(L.ALERT_TRANSITIONS)
    start = datetime(2024, 1, 1)
    acts = [(k, f"{i:05d}", start + timedelta(minutes=i), random.choice([*names, "NONSENSE"])) for k in "ab" for i in range(60)]
    state = spark.createDataFrame([("a", "OPEN"), ("b", "RESOLVED")], "k string, lifecycle_state string")
    df = spark.createDataFrame(acts, "k string, action_id string, acted_at timestamp, target_state string").repartition(5)
    got = {(r["k"], r["action_id"]): (r["from_state"], r["to_state"], r["accepted"]) for r in L.apply_actions(state, df, "k", L.ALERT_TRANSITIONS, chunk=7).collect()}
    now = {"a": "OPEN", "b": "RESOLVED"}
    for k, i, _, t in acts:
        ok = t in names and (t == now[k] or t in L.ALERT_TRANSITIONS[now[k]])
        assert got[k, i] == (now[k], t if ok else now[k], ok)
        now[k] = t if ok else now[k]


def test_trajectory_over_chunks(spark):
    random.seed(4)
    states = ["HEALTHY", "DEGRADED", "CRITICAL", "RECOVERING", "UNKNOWN"]
    rows = [("l", f"r{i}", i, random.choice(states), random.randint(20, 100)) for i in range(83)]
    df = spark.createDataFrame(rows, "lineage_id string, run_id string, run_index int, health_state string, health_index int").repartition(4)
    got = [r["score"] for r in R.trajectory(df, chunk=5).orderBy("run_index").collect()]
    s, want = 95, []
    for _, _, _, h, i in rows:
        s = {"CRITICAL": max(30, min(s - 15, i)), "DEGRADED": max(50, min(s - 8, i)), "RECOVERING": min(85, s + 6)}.get(h, min(100, s + 4))
        want.append(s)
    assert got == want


def test_clusters_equal_the_closure_of_all_pairs(spark):
    random.seed(12)
    pick = lambda xs: random.choice(xs)
    rows = [(f"a{i:03d}", "L", pick(["GLOBAL"] * 2 + [f"FEATURE::{j}" for j in range(25)]), pick([None] * 8 + ["i1", "i2"]), pick([None] * 8 + [1, 2]),
             pick(["r1", "r2", "r3"]), pick(["DRIFT", "BIAS"]), pick(["psi", "f1"]), pick(["r8", "r9"])) for i in range(60)]
    df = spark.createDataFrame(rows, "alert_id string, lineage_id string, target_key string, investigation string, track int, first_run string, "
                                     "source_module string, metric_name string, last_run string").repartition(4)

    def related(a, b):
        same = a[2] == b[2] != "GLOBAL"
        context = (a[3] is not None and a[3] == b[3]) or (a[4] is not None and a[4] == b[4])
        score = 35 * same + 25 * (a[3] is not None and a[3] == b[3]) + 20 * (a[4] is not None and a[4] == b[4]) + 20 * (a[5] == b[5]) + 10 * (a[6] == b[6]) + 10 * (a[7] == b[7]) + 10 * (a[8] == b[8])
        if "GLOBAL" not in (a[2], b[2]) and a[2] != b[2] and not context:
            return False
        return same or context or score >= 50

    label = {r[0]: r[0] for r in rows}
    changed = True
    while changed:
        changed = False
        for a in rows:
            for b in rows:
                if related(a, b) and label[a[0]] != label[b[0]]:
                    low = min(label[a[0]], label[b[0]])
                    label[a[0]] = label[b[0]] = low
                    changed = True
    assert {r["alert_id"]: r["incident_key"] for r in I.incident_clusters(df).collect()} == label


def test_json_array_table(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"a": 1, "b": "x"}, {"a": 2, "c": true}]')
    df = load_table(spark, f"file://{tmp_path}/t.json")
    assert set(df.columns) == {"a", "b", "c"} and df.count() == 2
    with pytest.raises(Exception):
        load_table(spark, f"{tmp_path}/absent.parquet")


def test_alert_stream(spark, tmp_path):
    t = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    rows = [("f", t(0), "HIGH", None), ("f", t(1), "CRITICAL", None), ("f", t(2), None, None), ("f", t(3), "HIGH", 2.0), ("f", t(9), "HIGH", None), ("g", t(1), "LOW", None)]
    schema = "fingerprint string, ts timestamp, severity string, suppress_hours double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = run_available(alert_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), "test").filter("fingerprint = 'f'")
    assert [r["event"] for r in out.orderBy("ts", "event").collect()] == [
        "CREATE", "ESCALATE", "AUTO_RESOLVE", "DEESCALATE", "REOPEN", "SUPPRESS", "SUPPRESSION_EXPIRED"]
