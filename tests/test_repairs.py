"""Nothing is cut, and results don't depend on chunks, reruns or text order."""

import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions.columns import row_key
from plumbline.functions.components import components
from plumbline.functions.cumulative import running_totals
from plumbline.operators import explain, fairness, forensics, quality, reliability
from plumbline.operators.predicates import numeric_features
from plumbline.plans.audit import AuditConfig, run_audit, store_audit
from plumbline.sources.tables import load_table, write_partition
from plumbline.streaming.alerts import AlertLifecycle


def test_all_numeric_columns_and_lineages_are_kept(spark):
    wide = spark.range(3).select(*[(F.col("id") * i).cast("double").alias(f"c{i}") for i in range(60)])
    assert len(numeric_features(wide)) == 60
    profiles = spark.createDataFrame([(f"m{i}", "CRITICAL", "DEGRADING") for i in range(25)] + [("x", "odd", "odd")], "lineage_id string, health_state string, trend string")
    cells = {(r.health, r.trend): r.lineages for r in reliability.risk_matrix(profiles).collect()}
    assert len(cells) == 9 and cells["CRITICAL", "DEGRADING"] == 25 and cells["HEALTHY", "STABLE"] == 1
    named = reliability.risk_matrix_lineages(profiles).filter("health = 'CRITICAL'").collect()
    assert {r.lineage_id for r in named} == {f"m{i}" for i in range(25)} and {r.risk for r in named} == {"CRITICAL"}


def test_small_groups_and_flat_features_are_flagged_not_dropped(spark):
    rows = [(i % 2, 0.9 if i % 3 else 0.2, "big" if i > 2 else "small", float(i), 7.0) for i in range(50)]
    et = forensics.evaluation_table(spark.createDataFrame(rows, "y int, p double, g string, x double, flat double"), "y", "p", 0.5)
    assert {r.grp: r.is_small for r in forensics.subgroup_errors(et, "g").collect()} == {"big": False, "small": True}
    ranges = forensics.error_ranges(et, ["x", "flat"]).collect()
    assert Counter((r.feature, r.is_testable) for r in ranges) == {("x", True): 5, ("flat", False): 1}


def test_permutation_takes_every_row_once_over_the_whole_table(spark):
    df = spark.range(500).select("id", F.col("id").cast("double").alias("v"))
    out = explain.shuffled(df, ["v"], ["id"], 2).collect()
    for d in ("_d0", "_d1"):
        assert sorted(r[d]["v"] for r in out) == [float(i) for i in range(500)]
        assert sum(r[d]["v"] == r.v for r in out) == 0
    assert len({(r.v, r["_d0"]["v"]) for r in out} & {(r.v, r["_d1"]["v"]) for r in out}) < 500


def test_rerun_without_findings_leaves_none(spark, tmp_path):
    rows = spark.createDataFrame([("a b/1", 1), ("other", 2)], "run_id string, n int")
    for run in ("a b/1", "other"):
        write_partition(rows, str(tmp_path / "t"), replaces=[run])
    assert {(r.run_id, r.n) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a b/1", 1), ("other", 2)}
    write_partition(rows.limit(0), str(tmp_path / "t"), replaces=["a b/1"])
    assert {(r.run_id, r.n) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("other", 2)}


def test_audit_of_one_module_and_of_none(spark, tmp_path):
    df = spark.createDataFrame([(i % 2, float(i)) for i in range(40)], "label int, x double")
    audit = run_audit("r", df, AuditConfig("label", modules=("LEAKAGE",)))
    assert audit.metrics.count() == 0 and audit.health.count() == 1
    store_audit(audit, str(tmp_path / "a"))
    skipped = run_audit("r", df, AuditConfig("label", modules=("DRIFT",)))
    assert skipped.findings.count() == 0 and [r.status for r in skipped.modules.collect()] == ["SKIPPED"]
    store_audit(skipped, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a/health")).count() == 0


def test_too_many_groups_leave_no_score(spark):
    rows = [(f"g{i % 51}", i % 2, 0.9 if i % 2 else 0.1) for i in range(51 * 40)]
    report = fairness.fairness_report(spark.createDataFrame(rows, "g string, y int, p double"), "y", "p", "g").first()
    assert report.health_score == 0.0 and not report.passed


def test_row_keys_tell_fields_and_nulls_apart(spark):
    rows = [("a||b", "c"), ("a", "b||c"), ("nan", "x"), (None, "x"), ("1:a", "b"), ("1", ":ab")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.select(row_key(df).alias("k")).distinct().count() == len(rows)


def test_role_names_are_equal_to_the_lists(spark):
    rows = [("subclass", 9, "text", None, None), ("y", 9, "numeric", 0.0, 5.0), ("default_rate", 9, "numeric", 0.0, 1.0), ("zip_code", 900, "text", None, None),
            ("y_hat", 50, "numeric", 0.0, 2.0), ("color", 4, "categorical", None, None), ("y_prob", 50, "numeric", 0.0, 1.0)]
    profile = spark.createDataFrame(rows, "feature string, distinct_count long, inferred_type string, min double, max double")
    assert {(r.feature, r.role) for r in quality.role_candidates(profile).collect()} == {
        ("y", "target"), ("zip_code", "protected"), ("y_hat", "prediction"), ("y_prob", "prediction")}
    assert {r.feature: r.score for r in quality.suggest_targets(profile).collect()} == {"y": 0.45}
    assert {r.feature: r.score for r in quality.suggest_predictions(profile).collect()} == {"y_prob": 0.9, "default_rate": 0.3}


def test_unknown_extensions_are_told_by_their_footer(spark, tmp_path):
    (tmp_path / "plain.dat").write_text("a,b\n1,2\n")
    assert [tuple(r) for r in load_table(spark, str(tmp_path / "plain.dat")).collect()] == [(1, 2)]
    spark.range(3).write.parquet(str(tmp_path / "table.dat"))
    assert load_table(spark, str(tmp_path / "table.dat")).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        load_table(spark, str(tmp_path / "none.dat"))


class _Handle:
    def __init__(self):
        self.now, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.now is not None

    def get(self):
        return self.now

    def update(self, value):
        self.now = value

    def clear(self):
        self.now = None

    def registerTimer(self, at):
        self.timers.append(at)


def _events(chunk):
    rng = random.Random(3)
    rows = [("f", pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h), rng.choice(["HIGH", "CRITICAL", None]), None) for h in range(40)]
    rng.shuffle(rows)
    frame = pd.DataFrame(rows, columns=["fingerprint", "ts", "severity", "suppress_hours"])
    handle, life = _Handle(), AlertLifecycle(retention_days=1)
    life.init(handle)
    out = pd.concat(list(life.handleInputRows(("f",), iter([frame[i:i + chunk] for i in range(0, 40, chunk)]), None)))
    return out, handle, life


def test_stream_order_does_not_depend_on_chunks():
    whole, _, _ = _events(100)
    parts, handle, life = _events(3)
    assert whole.reset_index(drop=True).equals(parts.reset_index(drop=True)) and whole.ts.is_monotonic_increasing

    class Due:
        def getExpiryTimeInMs(self):
            return handle.timers[-1]

    if handle.now[0] == "RESOLVED":
        list(life.handleExpiredTimer(("f",), None, Due()))
        assert handle.now is None


def test_a_hot_key_of_running_totals_is_split(spark):
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 60_000, numPartitions=16).select(
            F.when(F.col("id") % 10 < 6, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"), F.col("id").alias("at"), F.lit(1).alias("n"))
        out = running_totals(rows, ["k"], "at", ["n"], 64, bounded_keys=False)
        assert out.filter("k = 'hot'").count() == 36_000
        out.write.format("noop").mode("overwrite").save()
        found = out.groupBy("k").agg(F.max("lt_n").alias("m"), F.count("*").alias("c"))
        found.collect()
        assert found.filter("m <> c - 1").count() == 0
        seen = out.select("k", "lt_n")
        seen.collect()
        assert "skew=true" in seen._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_components_equal_union_find(spark):
    rng = random.Random(9)
    pairs = [(i, i + 1) for i in range(50)] + [(900, x) for x in range(901, 930)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[n] == find(n) for n in got) and {n for p in pairs for n in p if p[0] != p[1]} == set(got)
