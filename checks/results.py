"""Module results derived from line items: one run per supplier, one feature per line number.

Every metric is a fixed arithmetic function of the part keys sold, so the values
spread over all thresholds and the number of runs grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Feature metrics over h (sum of part keys of one supplier and line number).
FEATURE = {
    "psi": "(h % 41) / 100", "ks_p": "(h % 21) / 20", "importance_rank": "(h % 7) + 1", "mean_abs": "((h % 31) + 1) / 100",
    "sensitivity_rank": "(h % 9) + 1", "flip_rate": "(h % 29) / 100", "shift": "(h % 13) / 200", "mi": "(h % 53) / 100",
    "corr": "((h % 97) - 48) / 60", "leak": "(h % 83) / 100", "susp": "(h % 10) = 0", "null_rate": "(h % 19) / 100", "outlier_rate": "(h % 17) / 100",
    "is_const": "(h % 71) = 0", "distinct_n": "h % 1200", "stat": "((h % 61) - 30) / 100", "p": "(h % 11) / 100", "fp": "(h % 37) / 80", "fn": "(h % 43) / 90",
}
# Run metrics over g (sum of all part keys of the supplier).
RUN = {
    "f1": "(g % 100) / 100", "roc": "0.5 + (g % 50) / 100", "ece": "(g % 27) / 100", "fnr": "(g % 51) / 100", "brier": "(g % 33) / 100", "health": "50 + g % 50",
    "perf_ok": "(g % 3) <> 0", "dir": "0.5 + (g % 70) / 100", "dp": "(g % 30) / 100", "eo": "(g % 20) / 100", "bias_ok": "(g % 4) <> 0",
    "hce": "(g % 28) / 100", "hcn": "g % 12", "disp": "1 + (g % 9) / 10", "ga": "(g % 25) / 100", "gb": "(g % 35) / 100", "severe": "(g % 5) = 0",
    "fece": "(g % 22) / 100", "max_psi": "(g % 40) / 100", "drifted_n": "g % 4",
}
BASE = """hb AS (SELECT 'S' || l_suppkey AS run_id, l_suppkey AS k, 'f' || l_linenumber AS feature, l_linenumber AS ln, sum(l_partkey)::BIGINT AS h FROM lineitem GROUP BY ALL),
gb AS (SELECT run_id, k, sum(h)::BIGINT AS g, k % 6 <> 0 AS has_rob, k % 7 <> 0 AS has_bias FROM hb GROUP BY 1, 2)"""


def _num(e: str) -> str:
    return f"({e})::DOUBLE"


WIDE = f"""{BASE}, rl AS (SELECT run_id, has_rob, has_bias, 'f' || (g % 7 + 1) AS attr, {', '.join(f"({e})::{'BOOLEAN' if n in ('perf_ok', 'bias_ok', 'severe') else 'DOUBLE'} AS {n}_" for n, e in RUN.items())} FROM gb),
rn AS (SELECT run_id, has_rob, has_bias, CASE WHEN has_bias THEN attr END AS attr, f1_ AS f1, ece_ AS ece, fnr_ AS fnr, brier_ AS brier, health_ AS health, perf_ok_ AS perf_ok,
  CASE WHEN has_bias THEN dir_ END AS dir, CASE WHEN has_bias THEN dp_ END AS dp, CASE WHEN has_bias THEN eo_ END AS eo, CASE WHEN has_bias THEN bias_ok_ END AS bias_ok, hce_ AS hce, hcn_ AS hcn,
  CASE WHEN disp_ > 1 THEN disp_ WHEN ga_ > 0 AND gb_ > 0 THEN greatest(1, greatest(ga_, gb_) / least(ga_, gb_)) ELSE 1 END AS disp, ga_ AS ga, gb_ AS gb, severe_ AS severe,
  fece_ AS fece, max_psi_ AS max_psi, drifted_n_ AS drifted_n FROM rl),
fx AS (SELECT run_id, feature, {', '.join(f"({e})::{'BOOLEAN' if n in ('susp', 'is_const') else 'DOUBLE'} AS {n}_" for n, e in FEATURE.items())} FROM hb),
fw AS (SELECT fx.run_id, feature, psi_ AS psi, importance_rank_ AS rank, mean_abs_ AS attr_abs, mean_abs_ / sum(mean_abs_) OVER (PARTITION BY fx.run_id) AS share,
  CASE WHEN has_rob THEN sensitivity_rank_ END AS srank, CASE WHEN has_rob THEN flip_rate_ END AS flip, CASE WHEN has_rob THEN shift_ END AS shift, mi_ AS mi, abs(corr_) AS corr, leak_ AS leak, susp_ AS susp,
  null_rate_ AS nulls, outlier_rate_ AS outl, is_const_ AS const, distinct_n_ AS dn, abs(stat_) AS assoc, p_ AS p, fp_ AS fp, fn_ AS fn,
  abs(stat_) >= 0.15 AND p_ < 0.05 AS enr, psi_ >= 0.10 OR ks_p_ < 0.05 AS drifted FROM fx JOIN rn ON rn.run_id = fx.run_id)"""

_ILL = "(f1 < 0.60 OR ece > 0.05 OR fnr > 0.40 OR NOT perf_ok)"
_UNFAIR = "(dir < 0.85 OR dp > 0.05)"
_WEAK, _DRIFT = "(psi >= 0.08 OR drifted)", "(psi >= 0.10 OR drifted)"
_KEY = "(rank <= 3 OR share >= 0.15)"
_IMP = f"({_KEY} OR attr_abs >= 0.10)"
_SENS = "(srank <= 3 OR flip >= 0.02 OR shift >= 0.03)"
_ERR = "(assoc >= 0.15 OR enr OR fp >= 0.30 OR fn >= 0.30)"
_SUSP = "(susp OR leak >= 0.70)"
# name, modules, scope, predicate, severity test, (high, low), priority, confidence test or None
_RULES = [
    ("bias_drift", "BIAS,DRIFT", "F", f"{_UNFAIR} AND {_WEAK} AND feature = attr", "psi >= 0.20", "HM", "HIGH", "psi >= 0.10"),
    ("bias_performance", "BIAS,PERFORMANCE", "R", f"({_UNFAIR} OR eo > 0.04 OR NOT bias_ok) AND (f1 < 0.65 OR ece > 0.05 OR NOT perf_ok)", "dir < 0.80 OR dp > 0.10", "HM", "HIGH", "dir < 0.80 AND ece > 0.05"),
    ("confidence_calibration_error", "ERROR_FORENSICS,PERFORMANCE", "R", "(hce >= 0.10 OR hcn >= 5) AND (ece >= 0.08 OR severe)", "hce >= 0.20 OR ece >= 0.15", "CH", "SAME", None),
    ("data_quality_performance", "DATA_QUALITY,PERFORMANCE", "F", "(f1 < 0.60 OR ece > 0.05 OR health < 85) AND (nulls >= 0.03 OR outl >= 0.08 OR const)", "nulls >= 0.15 OR const", "HM", "MEDIUM", "nulls >= 0.05"),
    ("drift_explainability", "DRIFT,EXPLAINABILITY", "F", f"{_DRIFT} AND {_IMP}", "psi >= 0.25", "HM", "HIGH", "psi >= 0.10 AND rank <= 3"),
    ("drift_performance", "DRIFT,PERFORMANCE", "F", f"({_ILL} OR health < 85) AND {_WEAK}", "psi >= 0.25 OR f1 < 0.45", "HM", "HIGH", "psi >= 0.15 AND ece > 0.05"),
    ("drift_robustness", "DRIFT,ROBUSTNESS", "F", f"{_WEAK} AND {_SENS}", "psi >= 0.20 AND srank <= 2", "HM", "MEDIUM", "psi >= 0.10 AND flip >= 0.03"),
    ("error_bias", "ERROR_FORENSICS,BIAS", "R", "disp >= 1.30 AND (dir < 0.80 OR dp >= 0.10 OR eo >= 0.08)", "disp >= 1.5 OR dir < 0.70", "CH", "SAME", None),
    ("error_drift", "ERROR_FORENSICS,DRIFT", "F", f"{_DRIFT} AND {_ERR}", "psi >= 0.25 AND assoc >= 0.25", "CH", "SAME", "psi >= 0.15 AND assoc >= 0.20"),
    ("error_explainability", "ERROR_FORENSICS,EXPLAINABILITY", "F", f"(rank <= 5 OR share >= 0.10) AND {_ERR}", "rank <= 2 AND assoc >= 0.25", "CH", "SAME", "rank <= 3 AND assoc >= 0.20"),
    ("error_robustness", "ERROR_FORENSICS,ROBUSTNESS", "F", f"(flip >= 0.15 OR srank <= 3) AND {_ERR}", "flip >= 0.25 AND assoc >= 0.25", "CH", "SAME", "flip >= 0.20 AND assoc >= 0.20"),
    ("leakage_explainability", "LEAKAGE,EXPLAINABILITY", "F", f"({_SUSP} OR mi >= 0.25 OR corr >= 0.35 OR leak >= 0.60) AND {_IMP}", "mi >= 0.40 OR corr >= 0.60", "CH", "CRITICAL", "mi >= 0.30 AND rank <= 2"),
    ("multi_drift_performance", "DRIFT,EXPLAINABILITY,PERFORMANCE", "F", f"{_ILL} AND {_KEY} AND {_WEAK}", "psi >= 0.20 OR f1 < 0.40", "CH", "CRITICAL", None),
    ("multi_fairness_shift", "BIAS,PERFORMANCE,DRIFT", "R", f"{_UNFAIR} AND (f1 < 0.65 OR ece > 0.05) AND (max_psi >= 0.08 OR drifted_n >= 1)", "dir < 0.80", "HM", "HIGH", None),
    ("multi_fragile_feature", "EXPLAINABILITY,ROBUSTNESS,DRIFT", "F", f"{_KEY} AND (srank <= 3 OR flip >= 0.02) AND {_WEAK}", "rank = 1 OR psi >= 0.20", "CH", "CRITICAL", None),
    ("multi_leakage_proxy", "LEAKAGE,EXPLAINABILITY,DATA_QUALITY", "F", f"({_SUSP} OR mi >= 0.25 OR corr >= 0.35) AND {_KEY} AND (dn <= 5 OR dn > 900 OR const OR nulls < 0.001)", "true", "CH", "CRITICAL", None),
    ("robustness_explainability", "ROBUSTNESS,EXPLAINABILITY", "F", f"{_IMP} AND {_SENS}", "rank = 1 AND srank = 1", "HM", "MEDIUM", "rank <= 2 AND srank <= 2"),
]


def _rule_sql(r) -> str:
    name, modules, scope, when, sev, levels, prio, conf = r
    hi, lo = ("CRITICAL", "HIGH") if levels == "CH" else ("HIGH", "MEDIUM")
    severity = f"CASE WHEN {sev} THEN '{hi}' ELSE '{lo}' END"
    priority = severity if prio == "SAME" else f"'{prio}'"
    confidence = "'HIGH'" if conf is None else f"CASE WHEN {conf} THEN 'HIGH' ELSE 'MEDIUM' END"
    need = ["true"] + (["has_bias"] if "BIAS" in modules.split(",") else []) + (["has_rob"] if "ROBUSTNESS" in modules else [])
    src = "fw JOIN rn USING (run_id)" if scope == "F" else "rn"
    feature = "feature" if scope == "F" else "NULL::VARCHAR"
    return (f"SELECT run_id, {feature} AS feature, '{name}' AS rule, '{modules}' AS modules, {severity} AS severity, {priority} AS priority, {confidence} AS confidence "
            f"FROM {src} WHERE {' AND '.join(need)} AND ({when})")


CORR = f"""{WIDE}, c0 AS ({' UNION ALL '.join(_rule_sql(r) for r in _RULES)}),
corr_ AS (SELECT *, CASE priority WHEN 'CRITICAL' THEN 90 WHEN 'HIGH' THEN 70 WHEN 'MEDIUM' THEN 50 ELSE 30 END + CASE severity WHEN 'CRITICAL' THEN 8 WHEN 'HIGH' THEN 5 WHEN 'MEDIUM' THEN 3 ELSE 1 END
  + least(2.5 * len(string_split(modules, ',')), 10) AS score FROM c0)"""


def results(spark: SparkSession, sf: str) -> DataFrame:
    """run_id, module, status, result_json in several of the accepted layouts."""
    l = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.sum("l_partkey").alias("h"))
    run = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    f = l.select(run.alias("run_id"), F.col("l_suppkey").alias("k"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("feature"), "h",
                 *[F.expr(e).alias(n) for n, e in FEATURE.items()])
    cells = {
        "q": F.struct(F.col("null_rate").alias("nullRate"), F.col("outlier_rate").alias("outlierRate"), F.col("is_const").alias("isConstant"), F.col("distinct_n").alias("uniqueCount")),
        "l": F.struct(F.col("feature").alias("name"), F.col("mi").alias("mutualInformation"), F.col("corr").alias("targetAssociation"), F.col("leak").alias("suspicionScore"), F.col("susp").alias("isSuspicious")),
        "d": F.struct("feature", "psi", F.struct(F.col("ks_p").alias("p_value")).alias("ks")),
        "x": F.struct("feature", F.col("importance_rank").alias("rank"), F.col("mean_abs").alias("meanAbsShap")),
        "r": F.struct("feature", F.col("sensitivity_rank").alias("sensitivityRank"), F.col("flip_rate").alias("flipRate"), F.col("shift").alias("meanProbabilityShift")),
        "e": F.struct("feature", F.col("stat").alias("statistic"), F.col("p").alias("adjustedPValue")),
        "a": F.struct("feature", F.col("fp").alias("absoluteSeparation")),
        "b": F.struct("feature", F.col("fn").alias("standardizedMeanDifference")),
    }
    # Features of a run are at most the seven line numbers.
    per = f.groupBy("run_id", "k").agg(F.sum("h").alias("g"), F.map_from_entries(F.collect_list(F.struct("feature", cells["q"]))).alias("q"),
                                       *[F.collect_list(c).alias(n) for n, c in cells.items() if n != "q"])
    v = per.select("*", *[F.expr(e).alias(f"_{n}") for n, e in RUN.items()], F.concat(F.lit("f"), (F.col("g") % 7 + 1).cast("string")).alias("_attr"))
    c = lambda n, a: F.col(f"_{n}").alias(a)
    s = F.struct
    docs = {
        "DATA_QUALITY": s(s(F.lit(90.0).alias("healthScore")).alias("summary"), F.col("q").alias("columns")),
        "LEAKAGE": s(F.col("l").alias("features")),
        "DRIFT": s(s(c("max_psi", "maxPsi"), c("drifted_n", "driftedFeatureCount")).alias("summary"), F.col("d").alias("features")),
        "PERFORMANCE": s(s(c("f1", "f1"), c("roc", "rocAuc"), c("ece", "expectedCalibrationError"), c("fnr", "falseNegativeRate"), c("brier", "brierScore"), c("health", "healthScore"),
                           c("perf_ok", "passed")).alias("summary")),
        "EXPLAINABILITY": s(F.col("x").alias("globalImportance")),
        "BIAS": s(s(c("attr", "protectedAttribute"), c("dir", "disparateImpactRatio"), c("dp", "demographicParityGap"), c("eo", "equalOpportunityGap"), c("bias_ok", "passed")).alias("summary")),
        "ROBUSTNESS": s(s(F.col("r").alias("features")).alias("featureSensitivity")),
        "ERROR_FORENSICS": s(
            s(c("disp", "worstSubgroupDisparityRatio")).alias("summary"),
            s(c("hce", "highConfidenceErrorRate"), c("hcn", "highConfidenceErrorCount")).alias("confidenceAnalysis"),
            s(c("fece", "expectedCalibrationError"), F.array(s(F.lit(1).alias("binIndex"), c("severe", "isSevereGap"))).alias("bins")).alias("calibrationForensics"),
            F.array(s(F.lit("a").alias("group"), c("ga", "errorRate")), s(F.lit("b").alias("group"), c("gb", "errorRate"))).alias("subgroupAnalysis"),
            F.col("e").alias("featureAssociations"), s(F.col("a").alias("topSeparations")).alias("falsePositiveAnalysis"),
            s(F.col("b").alias("topFeatureDifferences")).alias("falseNegativeAnalysis")),
    }
    rows = F.array(*[s(F.lit(m).alias("module"), F.to_json(d).alias("result_json")) for m, d in docs.items()])
    bad = ((F.col("module") == "ROBUSTNESS") & (F.col("k") % 6 == 0)) | ((F.col("module") == "BIAS") & (F.col("k") % 7 == 0))
    return v.select("run_id", "k", F.inline(rows)).withColumn("status", F.when(bad, F.lit("FAILED")).otherwise(F.lit("COMPLETED"))).drop("k")
