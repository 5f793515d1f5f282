"""Running totals, quantiles, tails and association against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import tails
from plumbline.functions.columns import gaussian, uniform, wilson
from plumbline.functions.cumulative import cumulative_counts, quantiles
from plumbline.operators import association as A
from plumbline.operators import drift as D
from plumbline.operators import performance as P


def frame(spark, rows, schema, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def test_tail_probabilities_match_textbook_values():
    assert tails.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert tails.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-10)
    assert tails.student_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert tails.student_two_sided(12.706204736432095, 1) == pytest.approx(0.05, abs=1e-10)
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert tails.chi2_tail(0, 3) == 1.0


def test_kolmogorov_column(spark):
    # lambda = 1.3581 is the 5 % point of the limiting distribution
    d = 1.3580986393225505 / math.sqrt(5000)
    row = spark.range(1).select(tails.kolmogorov(F.lit(d), F.lit(10000), F.lit(10000)).alias("p")).first()
    assert row["p"] == pytest.approx(0.05, abs=1e-6)


@pytest.mark.parametrize("slices", [1, 4, 64])
def test_running_totals_do_not_depend_on_slices(spark, slices):
    random.seed(3)
    rows = [(random.choice("ab"), float(random.choice([1, 2, 2, 5, 7, random.random()]))) for _ in range(400)]
    got = cumulative_counts(frame(spark, rows, "k string, v double"), ["k"], "v", {"n": F.lit(1)}, slices).collect()
    for r in got:
        mine = [v for k, v in rows if k == r["k"]]
        assert (r["n"], r["lt_n"], r["tot_n"]) == (mine.count(r["v"]), sum(v < r["v"] for v in mine), len(mine))


def test_quantiles_are_exact(spark):
    random.seed(5)
    xs = [random.gauss(0, 1) for _ in range(301)] + [0.5] * 40
    df = frame(spark, [(x,) for x in xs], "x double")
    q = quantiles(df, {"x": F.col("x")}, {"a": 0.1, "b": 0.5, "c": 0.93}, 16).first()
    assert [q["a"], q["b"], q["c"]] == pytest.approx(list(np.quantile(xs, [0.1, 0.5, 0.93])))


def test_auc_and_average_precision_by_brute_force(spark):
    random.seed(7)
    rows = [(random.randint(0, 1), round(random.random(), 1)) for _ in range(200)]
    df = frame(spark, rows, "y int, p double")
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert P.roc_auc(df, "y", "p").first()[0] == pytest.approx(auc)
    ap = 0.0
    for t in sorted({p for _, p in rows}):
        hit = [y for y, p in rows if p >= t]
        ap += sum(1 for y, p in rows if y and p == t) / len(pos) * sum(hit) / len(hit)
    assert P.average_precision(df, "y", "p").first()[0] == pytest.approx(ap)


def test_ks_and_wasserstein_by_brute_force(spark):
    random.seed(11)
    a = [round(random.gauss(0, 1), 1) for _ in range(150)]
    b = [round(random.gauss(0.4, 1.2), 1) for _ in range(170)]
    one, two = frame(spark, [(x,) for x in a], "x double"), frame(spark, [(x,) for x in b], "x double")
    grid = sorted(set(a) | set(b))
    cdf = lambda s, v: sum(x <= v for x in s) / len(s)
    assert D.ks_2samp(one, two, ["x"]).first()["ks"] == pytest.approx(max(abs(cdf(a, v) - cdf(b, v)) for v in grid))
    w = sum(abs(cdf(a, v) - cdf(b, v)) * (n - v) for v, n in zip(grid, grid[1:]))
    assert D.wasserstein(one, two, ["x"]).first()["wasserstein"] == pytest.approx(w)


def test_constant_baseline_psi(spark):
    base = frame(spark, [(1.0,)] * 10, "x double")
    ev = frame(spark, [(1.0,)] * 6 + [(2.0,)] * 4, "x double")
    assert D.numeric_psi(base, ev, ["x"]).first()["psi"] == pytest.approx(2.0)
    assert D.numeric_psi(base, base, ["x"]).first()["psi"] == pytest.approx(0.0)


def test_drift_pair(spark):
    rng = np.random.default_rng(42)
    still = [frame(spark, [(float(x),) for x in rng.normal(100, 15, 2000)], "num double") for _ in range(2)]
    row = D.drift_features(*still, ["num"], []).first()
    assert row["severity"] == "LOW" and row["psi"] < 0.1 and not row["significant"]
    moved = frame(spark, [(float(x),) for x in rng.normal(140, 25, 2000)], "num double")
    assert D.drift_features(still[0], moved, ["num"], []).first()["severity"] == "CRITICAL"


def test_cramers_v_of_a_copy_is_one(spark):
    df = frame(spark, [(str(i % 2), i % 2) for i in range(500)], "c string, y int")
    assert A.cramers_v(df, ["c"], "y").first()["cramers_v"] == pytest.approx(1.0)


def test_fdr(spark):
    ps = [0.01, 0.04, 0.03, 0.20]
    df = frame(spark, [(f"f{i}", p) for i, p in enumerate(ps)], "feature string, p double")
    got = {r["feature"]: r["p_adjusted"] for r in A.fdr(df, "p", [], "feature").collect()}
    assert [got[f"f{i}"] for i in range(4)] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.20])


def test_hash_draws_do_not_depend_on_partitioning(spark):
    df = spark.range(2000)
    a = {r[0]: r[1] for r in df.select("id", uniform(F.col("id"), "x", 42)).collect()}
    b = {r[0]: r[1] for r in df.repartition(13).select("id", uniform(F.col("id"), "x", 42)).collect()}
    assert a == b and 0.45 < sum(a.values()) / 2000 < 0.55
    g = [r[0] for r in df.select(gaussian(F.col("id"), "x", 42)).collect()]
    assert abs(np.mean(g)) < 0.1 and abs(np.std(g) - 1) < 0.1


def test_wilson(spark):
    low, high = wilson(F.lit(8), F.lit(10))
    r = spark.range(1).select(low.alias("a"), high.alias("b")).first()
    assert (round(r["a"], 4), round(r["b"], 4)) == (0.4902, 0.9433)
    empty = [c.alias(n) for c, n in zip(wilson(F.lit(0), F.lit(0)), "ab")]
    assert tuple(spark.range(1).select(*empty).first()) == (0.0, 0.0)
