"""Known answers of the audits on small tables."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import experiments as E
from plumbline.operators import explain as X
from plumbline.operators import fairness as G
from plumbline.operators import forensics as N
from plumbline.operators import leakage as L
from plumbline.operators import performance as P
from plumbline.operators import predicates as R
from plumbline.operators import quality as Q
from plumbline.operators import robustness as B
from plumbline.operators import scoring as S


def frame(spark, rows, schema, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def test_quality_counts(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(float(i), "prod", "US", inf if i < 3 else 1.0) for i in range(95)] + [(nan, "prod", "CA", 1.0)] * 5
    df = frame(spark, rows, "age double, env string, country string, ratio double")
    p = {r["feature"]: r for r in Q.column_profile(df).collect()}
    assert p["age"]["missing_count"] == 5 and p["env"]["is_constant"] and p["ratio"]["infinite_count"] == 3
    assert Q.duplicate_rows(df).first()["duplicate_rows"] == 4
    codes = {(r["feature"], r["code"]) for r in Q.quality_findings(df).collect()}
    assert {("age", "missing_elevated"), ("env", "constant"), ("ratio", "infinite_values"), (None, "duplicates_elevated")} <= codes


def test_empty_table_scores_zero(spark):
    df = spark.createDataFrame([], "a double, b string")
    row = Q.quality_health(Q.quality_findings(df)).first()
    assert row["health_score"] == 0 and not row["passed"]


def test_iqr_needs_four_values(spark):
    row = Q.iqr_outliers(frame(spark, [(1.0,), (2.0,), (900.0,)], "x double")).first()
    assert row["outlier_count"] == 0 and row["lower_bound"] is None


def test_overlap_of_three_rows(spark):
    ev = frame(spark, [(1, 0), (2, 1), (3, 0), (4, 1), (5, 0)], "feat_x long, target long")
    base = frame(spark, [(1, 0), (2, 1), (3, 0), (14, 1), (15, 0)], "feat_x long, target long")
    row = L.sample_overlap(ev, base).first()
    assert (row["overlap_count"], row["overlap_rate"], row["severity"]) == (3, 0.6, "CRITICAL")


def test_leaked_feature_is_found(spark):
    rows = [(i % 2, float(i % 2) + (i % 7) / 100, str(i % 2), (i * 37 % 101) / 100) for i in range(500)]
    df = frame(spark, rows, "y int, leaked double, copy string, noise double")
    risk = {r["feature"]: r["risk"] for r in L.leakage_rank(df, "y").collect()}
    assert risk == {"leaked": "CRITICAL", "copy": "CRITICAL", "noise": "LOW"}
    assert not L.leakage_health(L.leakage_findings(df, "y")).first()["passed"]
    assert L.leakage_findings(df, "gone").first()["code"] == "target_missing"


def test_fairness_known_answer(spark):
    cells = {"A": (40, 10, 10, 40), "B": (20, 30, 5, 45)}
    rows = []
    for g, (tp, fn, fp, tn) in cells.items():
        rows += [(g, 1, 0.9)] * tp + [(g, 1, 0.1)] * fn + [(g, 0, 0.9)] * fp + [(g, 0, 0.1)] * tn
    gm = G.group_metrics(frame(spark, rows, "g string, y int, p double"), "y", "p", "g")
    s = G.fairness_summary(gm).first()
    assert s["worst_impact_ratio"] == pytest.approx(0.5) and s["dp_gap"] == pytest.approx(0.25)
    assert s["tpr_gap"] == pytest.approx(0.4) and s["odds_gap"] == pytest.approx(0.4) and s["reference"] == "A"


def test_labels(spark):
    df = frame(spark, [("Y",), ("N",), (None,)], "l string")
    got = {(r["l"], r["y"]) for r in R.map_binary(df, "l").collect()}
    assert got == {("Y", 1), ("N", 0), (None, None)}
    with pytest.raises(ValueError):
        R.map_binary(frame(spark, [("a",), ("b",), ("c",)], "l string"), "l")


def test_single_class_and_repartitioning(spark):
    one = frame(spark, [(1, 0.4), (1, 0.6)], "y int, p double")
    m = P.performance_metrics(one, "y", "p")
    assert m.first()["roc_auc"] is None
    assert "single_class" in {r["code"] for r in P.performance_findings(m, P.prediction_audit(one, "y", "p")).collect()}
    rows = [(i % 3 == 0, ((i * 7919) % 1000) / 1000) for i in range(900)]
    df = spark.createDataFrame(rows, "y boolean, p double").withColumn("y", F.col("y").cast("int"))
    a, b = (P.performance_metrics(d, "y", "p").first() for d in (df.repartition(1), df.orderBy(F.desc("p")).repartition(11)))
    for k in a.asDict():
        assert a[k] == pytest.approx(b[k]) if isinstance(a[k], float) else a[k] == b[k]


def test_error_table_and_top(spark):
    rows = [(i, int(i % 2 == 0), 0.9 if i % 5 else 0.2) for i in range(100)]
    et = N.evaluation_table(frame(spark, rows, "id long, y int, p double"), "y", "p")
    top = N.top_errors(et, ["id"], 3).collect()
    assert [r["id"] for r in top] == [1, 3, 7] and top[0]["error_type"] == "FP"
    assert sum(r["n"] for r in N.error_distribution(et).collect()) == 100


def test_transforms(spark):
    df = frame(spark, [(1.0, "a"), (2.0, "a"), (3.0, None), (4.0, "b"), (100.0, "a")], "v double, c string")
    assert {r["v"] for r in E.ablate(df, "v").collect()} == {0.0} and E.ablate(df, "v", "drop").columns == ["c"]
    assert {r["c"] for r in E.ablate(df, "c", "median").collect()} == {"a"}
    clipped = E.clip(df, "v", 0.1, 0.8, "moved")
    assert clipped.agg(F.max("v")).first()[0] < 100 and clipped.filter("moved").count() == 2
    assert E.fill_missing(df, "c").filter("c is null").count() == 0
    z = E.standardize(df, "v").agg(F.avg("v"), F.stddev_samp("v")).first()
    assert z[0] == pytest.approx(0, abs=1e-12) and z[1] == pytest.approx(1)
    nums = spark.range(100).withColumn("num", F.col("id").cast("double"))
    m = [sorted(r["id"] for r in E.inject_missing(nums.repartition(n), "num", 0.2, 42, ["id"]).filter("num is null").collect()) for n in (1, 7)]
    assert m[0] == m[1] and 5 < len(m[0]) < 40
    assert E.inject_missing(nums, "num", 1e-9, 42, ["id"]).filter("num is null").count() == 1


def test_paired_comparison(spark):
    rows = list(zip([0, 1] * 5, [0, 0, 0, 1, 0, 1, 0, 0, 0, 1], [0, 1] * 5))
    r = E.paired_comparison(frame(spark, rows, "y int, b int, c int"), "y", "b", "c").first()
    assert r["changed"] == 2 and r["flip_rate"] == pytest.approx(0.2) and r["mcnemar"] == pytest.approx(0.5)
    assert r["mcnemar_p"] == pytest.approx(0.4795001221869535)


def test_acceptance_is_inconclusive_without_a_measure(spark):
    deltas = frame(spark, [("f1", 0.6, 0.7, 0.1)], "metric string, baseline double, candidate double, delta double")
    crit = E.criteria_table(spark, [("ACCEPT", "f1", "DELTA_GE", 0.0), ("ACCEPT", "ece", "DELTA_LT", 0.0)])
    assert E.evaluate_acceptance(deltas, crit).first()["conclusion"] == "INCONCLUSIVE"
    assert E.evaluate_acceptance(deltas, crit.filter("metric = 'f1'")).first()["conclusion"] == "VALIDATED"


def test_models(spark):
    rows = [(i, (i % 20 - 10) / 5, ((i * 7) % 13 - 6) / 6) for i in range(400)]
    df = frame(spark, rows, "id long, strong double, weak double").withColumn("y", (F.col("strong") * 3 + F.col("weak") * 0.8 > 0).cast("int"))
    model = S.LinearModel({"strong": 3.0, "weak": 0.8})
    python = lambda pdf: 1 / (1 + __import__("numpy").exp(-(3 * pdf["strong"] + 0.8 * pdf["weak"])))
    a = {r["id"]: r["p"] for r in S.score(df, model, ["strong", "weak"]).collect()}
    b = {r["id"]: r["p"] for r in S.score(df, python, ["strong", "weak"]).collect()}
    assert a == pytest.approx(b)
    # The in-row search of a column model agrees with the exploded search of a Python model.
    scales = {"strong": 1.0, "weak": 1.0}
    d1 = {r["id"]: (r["feature"], r["distance"]) for r in B.boundary_distances(df, model, ["strong", "weak"], ["id"], scales=scales).collect()}
    d2 = {r["id"]: (r["feature"], r["distance"]) for r in B.boundary_distances(df, python, ["strong", "weak"], ["id"], scales=scales).collect()}
    assert d1 == d2
    flips = [r["flip_rate"] for r in B.jitter_sensitivity(df, model, ["strong", "weak"], ["id"], "y").orderBy("level").collect()]
    assert flips == sorted(flips)
    imp = X.permutation_importance(df, model, "y", ["strong", "weak"], ["id"], 2).orderBy("rank").collect()
    assert imp[0]["feature"] == "strong"
    s = X.shuffled(df, ["strong"], ["id"], 2).select("strong", "_d0.strong", "_d1.strong").collect()
    assert sorted(r[0] for r in s) == sorted(r[1] for r in s) == sorted(r[2] for r in s)
