"""Cross-module rules, investigations, remediations and the evidence graph.

A rule is a record of column expressions over one wide evidence row, so all
rules are evaluated in one pass and a user adds a rule by adding a record.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp

FEATURE_METRICS = [
    "psi", "ks_p", "ks_statistic", "wasserstein", "drift_detected", "importance_rank", "mean_abs_attribution", "attribution_share",
    "sensitivity_rank", "flip_rate", "mean_probability_shift", "mutual_info", "target_correlation", "leakage_score", "is_suspicious",
    "null_rate", "outlier_rate", "is_constant", "distinct_count", "error_association", "error_correlation", "error_p", "fp_separation", "fn_separation",
]
RUN_METRICS = [
    "f1", "roc_auc", "expected_calibration_error", "brier_score", "false_negative_rate", "worst_disparate_impact_ratio", "demographic_parity_gap",
    "equal_opportunity_gap", "high_confidence_error_rate", "high_confidence_error_count", "overall_error_rate", "subgroup_disparity_ratio",
    "severe_calibration_bins", "forensic_calibration_error", "max_psi", "drifted_feature_count",
]
MODULES = ["DATA_QUALITY", "LEAKAGE", "DRIFT", "PERFORMANCE", "EXPLAINABILITY", "BIAS", "ROBUSTNESS", "ERROR_FORENSICS"]


def evidence_wide(norm: DataFrame) -> DataFrame:
    """One row per (run, feature) with every feature metric; a missing attribution share is computed."""
    pick = [F.max(F.when(F.col("metric_name") == m, F.col("metric_value"))).alias(m) for m in FEATURE_METRICS]
    seen = lambda m: F.max((F.col("module") == m).cast("int")).alias(f"in_{m}")
    wide = norm.filter(F.col("target_type") == "FEATURE").groupBy(
        "run_id", F.expr("substring(target_key, 10)").alias("feature")).agg(*pick, *[seen(m) for m in MODULES])
    # Features of one run are bounded by the schema of its table.
    whole = F.sum("mean_abs_attribution").over(Window.partitionBy("run_id"))
    share = F.coalesce("attribution_share", F.try_divide(F.col("mean_abs_attribution"), whole))
    enriched = (F.col("error_association") >= 0.15) & (F.col("error_p") < 0.05)
    drifted = F.coalesce(F.col("drift_detected") == 1, (F.col("psi") >= 0.10) | (F.coalesce("ks_p", F.lit(1.0)) < 0.05))
    return wide.withColumns({"attribution_share": share, "error_enriched": F.coalesce(enriched, F.lit(False)), "drifted": F.coalesce(drifted, F.lit(False))})


def run_level(norm: DataFrame) -> DataFrame:
    """One row per run: global metrics, pass flags and the modules that completed."""
    glob = F.col("target_type") == "GLOBAL"
    pick = [F.max(F.when(glob & (F.col("metric_name") == m), F.col("metric_value"))).alias(m) for m in RUN_METRICS]
    flag = lambda module, metric, out: F.max(
        F.when(glob & (F.col("module") == module) & (F.col("metric_name") == metric), F.col("metric_value"))).alias(out)
    sub = F.when((F.col("metric_name") == "subgroup_error_rate") & (F.col("metric_value") > 0), F.col("metric_value"))
    out = norm.groupBy("run_id").agg(
        *pick,
        flag("PERFORMANCE", "passed", "performance_passed"), flag("PERFORMANCE", "health_score", "performance_health"),
        flag("BIAS", "passed", "bias_passed"),
        F.max(F.when(F.col("metric_name") == "protected_attribute", F.col("label"))).alias("protected_attribute"),
        F.array_sort(F.collect_set("module")).alias("modules"),
        F.max(sub).alias("_hi"), F.min(sub).alias("_lo"),
    )
    given = F.coalesce("subgroup_disparity_ratio", F.lit(1.0))
    ratio = F.when(given > 1.0, given).otherwise(F.greatest(given, F.coalesce(F.try_divide(F.col("_hi"), F.col("_lo")), F.lit(1.0))))
    return out.withColumn("subgroup_disparity_ratio", ratio).drop("_hi", "_lo")


@dataclass
class Correlation:
    rule: str
    modules: Sequence[str]
    scope: str  # FEATURE or RUN
    when: Column
    severity: Column | str
    priority: Column | str
    confidence: Column | str


def _c(name: str) -> Column:
    return F.col(name)


def _pick(cond: Column, yes: str, no: str) -> Column:
    return F.when(cond, F.lit(yes)).otherwise(F.lit(no))


def correlation_rules() -> list[Correlation]:
    """The built-in rules. Thresholds are fixed values."""
    psi, rank, share, attr = _c("psi"), _c("importance_rank"), _c("attribution_share"), _c("mean_abs_attribution")
    srank, flip, shift, assoc = _c("sensitivity_rank"), _c("flip_rate"), _c("mean_probability_shift"), _c("error_association")
    mi, corr, leak = _c("mutual_info"), F.abs("target_correlation"), _c("leakage_score")
    f1, ece, fnr = _c("f1"), _c("expected_calibration_error"), _c("false_negative_rate")
    dir_, dp, eo = _c("worst_disparate_impact_ratio"), _c("demographic_parity_gap"), _c("equal_opportunity_gap")
    hce, hcn, disparity = _c("high_confidence_error_rate"), _c("high_confidence_error_count"), _c("subgroup_disparity_ratio")
    failed = _c("performance_passed") == 0
    weak_drift, drift = (psi >= 0.08) | _c("drifted"), (psi >= 0.10) | _c("drifted")
    key = (rank <= 3) | (share >= 0.15)
    important = key | (attr >= 0.10)
    sensitive = (srank <= 3) | (flip >= 0.02) | (shift >= 0.03)
    errors = (assoc >= 0.15) | _c("error_enriched") | (_c("fp_separation") >= 0.30) | (_c("fn_separation") >= 0.30)
    suspicious = (_c("is_suspicious") == 1) | (leak >= 0.70)
    unfair = (dir_ < 0.85) | (dp > 0.05)
    ill = (f1 < 0.60) | (ece > 0.05) | (fnr > 0.40) | failed
    unhealthy = _c("performance_health") < 85
    severe = lambda c: _pick(c, "CRITICAL", "HIGH")
    medium = lambda c: _pick(c, "HIGH", "MEDIUM")
    hard_drift_error = (psi >= 0.25) & (assoc >= 0.25)
    hard_rank_error = (rank <= 2) & (assoc >= 0.25)
    hard_flip_error = (flip >= 0.25) & (assoc >= 0.25)
    hot = (hce >= 0.20) | (ece >= 0.15)
    unequal = (disparity >= 1.50) | (dir_ < 0.70)
    context = (_c("distinct_count") <= 5) | (_c("distinct_count") > 900) | (_c("is_constant") == 1) | (_c("null_rate") < 0.001)
    return [
        Correlation("bias_drift", ["BIAS", "DRIFT"], "FEATURE", unfair & weak_drift & (_c("feature") == _c("protected_attribute")),
                    medium(psi >= 0.20), "HIGH", medium(psi >= 0.10)),
        Correlation("bias_performance", ["BIAS", "PERFORMANCE"], "RUN",
                    (unfair | (eo > 0.04) | (_c("bias_passed") == 0)) & ((f1 < 0.65) | (ece > 0.05) | failed),
                    medium((dir_ < 0.80) | (dp > 0.10)), "HIGH", medium((dir_ < 0.80) & (ece > 0.05))),
        Correlation("confidence_calibration_error", ["ERROR_FORENSICS", "PERFORMANCE"], "RUN",
                    ((hce >= 0.10) | (hcn >= 5)) & ((ece >= 0.08) | (_c("severe_calibration_bins") > 0)), severe(hot), severe(hot), "HIGH"),
        Correlation("data_quality_performance", ["DATA_QUALITY", "PERFORMANCE"], "FEATURE",
                    ((f1 < 0.60) | (ece > 0.05) | unhealthy) & ((_c("null_rate") >= 0.03) | (_c("outlier_rate") >= 0.08) | (_c("is_constant") == 1)),
                    medium((_c("null_rate") >= 0.15) | (_c("is_constant") == 1)), "MEDIUM", medium(_c("null_rate") >= 0.05)),
        Correlation("drift_explainability", ["DRIFT", "EXPLAINABILITY"], "FEATURE", drift & important, medium(psi >= 0.25), "HIGH",
                    medium((psi >= 0.10) & (rank <= 3))),
        Correlation("drift_performance", ["DRIFT", "PERFORMANCE"], "FEATURE", (ill | unhealthy) & weak_drift, medium((psi >= 0.25) | (f1 < 0.45)),
                    "HIGH", medium((psi >= 0.15) & (ece > 0.05))),
        Correlation("drift_robustness", ["DRIFT", "ROBUSTNESS"], "FEATURE", weak_drift & sensitive, medium((psi >= 0.20) & (srank <= 2)), "MEDIUM",
                    medium((psi >= 0.10) & (flip >= 0.03))),
        Correlation("error_bias", ["ERROR_FORENSICS", "BIAS"], "RUN", (disparity >= 1.30) & ((dir_ < 0.80) | (dp >= 0.10) | (eo >= 0.08)),
                    severe(unequal), severe(unequal), "HIGH"),
        Correlation("error_drift", ["ERROR_FORENSICS", "DRIFT"], "FEATURE", drift & errors, severe(hard_drift_error), severe(hard_drift_error),
                    medium((psi >= 0.15) & (assoc >= 0.20))),
        Correlation("error_explainability", ["ERROR_FORENSICS", "EXPLAINABILITY"], "FEATURE", ((rank <= 5) | (share >= 0.10)) & errors,
                    severe(hard_rank_error), severe(hard_rank_error), medium((rank <= 3) & (assoc >= 0.20))),
        Correlation("error_robustness", ["ERROR_FORENSICS", "ROBUSTNESS"], "FEATURE", ((flip >= 0.15) | (srank <= 3)) & errors,
                    severe(hard_flip_error), severe(hard_flip_error), medium((flip >= 0.20) & (assoc >= 0.20))),
        Correlation("leakage_explainability", ["LEAKAGE", "EXPLAINABILITY"], "FEATURE",
                    (suspicious | (mi >= 0.25) | (corr >= 0.35) | (leak >= 0.60)) & important, severe((mi >= 0.40) | (corr >= 0.60)), "CRITICAL",
                    medium((mi >= 0.30) & (rank <= 2))),
        Correlation("multi_drift_performance", ["DRIFT", "EXPLAINABILITY", "PERFORMANCE"], "FEATURE", ill & key & weak_drift,
                    severe((psi >= 0.20) | (f1 < 0.40)), "CRITICAL", "HIGH"),
        Correlation("multi_fairness_shift", ["BIAS", "PERFORMANCE", "DRIFT"], "RUN",
                    unfair & ((f1 < 0.65) | (ece > 0.05)) & ((_c("max_psi") >= 0.08) | (_c("drifted_feature_count") >= 1)), medium(dir_ < 0.80), "HIGH", "HIGH"),
        Correlation("multi_fragile_feature", ["EXPLAINABILITY", "ROBUSTNESS", "DRIFT"], "FEATURE", key & ((srank <= 3) | (flip >= 0.02)) & weak_drift,
                    severe((rank == 1) | (psi >= 0.20)), "CRITICAL", "HIGH"),
        Correlation("multi_leakage_proxy", ["LEAKAGE", "EXPLAINABILITY", "DATA_QUALITY"], "FEATURE",
                    (suspicious | (mi >= 0.25) | (corr >= 0.35)) & key & context, "CRITICAL", "CRITICAL", "HIGH"),
        Correlation("robustness_explainability", ["ROBUSTNESS", "EXPLAINABILITY"], "FEATURE", important & sensitive,
                    medium((rank == 1) & (srank == 1)), "MEDIUM", medium((rank <= 2) & (srank <= 2))),
    ]


def priority_score(priority: Column, severity: Column, modules: Column) -> Column:
    """Base by priority + bonus by severity + 2.5 per module, at most 10."""
    base = F.when(priority == "CRITICAL", 90.0).when(priority == "HIGH", 70.0).when(priority == "MEDIUM", 50.0).when(priority == "LOW", 30.0).otherwise(10.0)
    bonus = F.when(severity == "CRITICAL", 8.0).when(severity == "HIGH", 5.0).when(severity == "MEDIUM", 3.0).when(severity == "LOW", 1.0).otherwise(0.0)
    return base + bonus + F.least(modules * 2.5, F.lit(10.0))


def _col(v: Column | str) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _present(modules: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.array_contains("modules", m) for m in modules])


def correlations(wide: DataFrame, runs: DataFrame, rules: Sequence[Correlation] | None = None) -> DataFrame:
    """run_id, feature (NULL for run-level), rule, modules, severity, priority, confidence, score."""
    rules = list(rules) if rules is not None else correlation_rules()

    def fire(df: DataFrame, scope: str, feature: Column) -> DataFrame:
        cells = [
            F.when(_present(r.modules) & r.when, F.struct(
                F.lit(r.rule).alias("rule"), F.array(*[F.lit(m) for m in r.modules]).alias("rule_modules"), _col(r.severity).alias("severity"),
                _col(r.priority).alias("priority"), _col(r.confidence).alias("confidence")))
            for r in rules if r.scope == scope
        ]
        return df.select("run_id", feature.alias("feature"), F.inline(F.filter(F.array(*cells), lambda c: c.isNotNull())))

    by_feature = fire(wide.join(runs, "run_id"), "FEATURE", F.col("feature"))
    out = by_feature.unionByName(fire(runs, "RUN", F.lit(None).cast("string")))
    return out.withColumn("score", priority_score(F.col("priority"), F.col("severity"), F.size("rule_modules")))


def run_summary(corr: DataFrame, modules: DataFrame) -> DataFrame:
    """Per run: correlations by priority, strongest feature, modules by status."""
    p = F.col("priority")
    c = corr.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("correlations"), F.count_if(p == "CRITICAL").alias("critical"), F.count_if(p == "HIGH").alias("high"),
        F.count_if(p == "MEDIUM").alias("medium"), F.count_if(p == "LOW").alias("low"), F.max("score").alias("max_score"))
    top = corr.filter(F.col("feature").isNotNull()).groupBy("run_id", "feature").agg(F.sum("score").alias("s")).groupBy("run_id").agg(
        F.min_by("feature", F.struct(-F.col("s"), F.col("feature"))).alias("top_feature"), F.count(F.lit(1)).alias("features"))
    s = F.col("status")
    m = modules.groupBy("run_id").agg(F.count_if(s == "COMPLETED").alias("modules_completed"), F.count_if(s == "FAILED").alias("modules_failed"))
    return m.join(c, "run_id", "left").join(top, "run_id", "left").fillna(0, ["correlations", "critical", "high", "medium", "low", "features"])


def feature_profiles(corr: DataFrame) -> DataFrame:
    """Features by summed score: rules, modules involved, highest priority score."""
    return corr.filter(F.col("feature").isNotNull()).groupBy("run_id", "feature").agg(
        F.count(F.lit(1)).alias("rules"), F.sum("score").alias("total_score"), F.max("score").alias("max_score"),
        F.size(F.array_distinct(F.flatten(F.collect_set("rule_modules")))).alias("modules"))


def module_contributions(corr: DataFrame) -> DataFrame:
    return corr.select("run_id", "score", F.explode("rule_modules").alias("module")).groupBy("run_id", "module").agg(
        F.count(F.lit(1)).alias("rules"), F.sum("score").alias("score"))


def priority_level(score: Column) -> Column:
    return F.when(score >= 85, F.lit("CRITICAL")).when(score >= 65, F.lit("HIGH")).when(score >= 45, F.lit("MEDIUM")).when(score >= 25, F.lit("LOW")).otherwise(F.lit("INFO"))


def confidence_level(modules: Column, score: Column) -> Column:
    return (
        F.when((modules >= 3) | ((modules >= 2) & (score >= 80)), F.lit("HIGH"))
        .when((modules >= 2) | (score >= 60), F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )


def module_evidence() -> dict[str, Column]:
    """What counts as evidence of each module for a feature."""
    return {
        "DRIFT": _c("drifted") | (_c("psi") >= 0.05),
        "EXPLAINABILITY": (_c("importance_rank") <= 5) | (_c("attribution_share") >= 0.05) | (_c("mean_abs_attribution") > 0.05),
        "ROBUSTNESS": (_c("flip_rate") >= 0.01) | (_c("sensitivity_rank") <= 3),
        "ERROR_FORENSICS": _c("error_enriched") | (_c("error_association") >= 0.10) | (F.abs("fp_separation") >= 0.20) | (F.abs("fn_separation") >= 0.20),
        "LEAKAGE": (_c("is_suspicious") == 1) | (_c("leakage_score") >= 0.50) | (_c("mutual_info") >= 0.20),
        "DATA_QUALITY": (_c("null_rate") >= 0.01) | (_c("outlier_rate") >= 0.05) | (_c("is_constant") == 1),
    }


INVESTIGATION = ["run_id", "target_type", "target_key", "supporting_modules", "findings", "evidence", "score", "priority", "confidence"]


def feature_investigations(wide: DataFrame, corr: DataFrame) -> DataFrame:
    """Feature targets: base from the strongest rule or signal, bonus for converging modules and signal strength."""
    # A feature has at most one row per rule, so both collections are bounded by the rule list.
    per = corr.filter(F.col("feature").isNotNull()).groupBy("run_id", "feature").agg(
        F.max("score").alias("_rule_score"), F.count(F.lit(1)).alias("findings"), F.array_distinct(F.flatten(F.collect_list("rule_modules"))).alias("_rule_modules"))
    joined = wide.join(per, ["run_id", "feature"], "left")
    own = F.array(*[F.when(cond, F.lit(m)) for m, cond in module_evidence().items()])
    own = F.filter(own, lambda m: m.isNotNull())
    base = (
        F.coalesce("_rule_score", F.when(_c("psi") >= 0.25, 70.0).when(_c("error_enriched"), 65.0).when(_c("importance_rank") <= 2, 55.0).otherwise(30.0))
    )
    signal = (
        F.when(_c("psi") >= 0.25, 3.0).when(_c("psi") >= 0.10, 1.5).otherwise(0.0)
        + F.when(_c("importance_rank") == 1, 3.0).when(_c("importance_rank") <= 3, 1.5).otherwise(0.0)
        + F.when(_c("error_association") >= 0.25, 3.0).when(_c("error_association") >= 0.15, 1.5).otherwise(0.0)
        + F.when(_c("flip_rate") >= 0.10, 2.5).when(_c("flip_rate") >= 0.03, 1.0).otherwise(0.0)
    )
    n = F.size("supporting_modules")
    staged = joined.withColumns({
        "evidence": F.size(own),
        "supporting_modules": F.array_sort(F.array_union(own, F.coalesce("_rule_modules", F.array().cast("array<string>")))),
        "findings": F.coalesce("findings", F.lit(0)),
    }).filter((n > 0) | (F.col("findings") > 0))
    score = clamp(base + F.least((n - 1) * 3.5, F.lit(14.0)) + F.least(signal, F.lit(10.0)), 10, 99.5)
    return staged.select(
        "run_id", F.lit("FEATURE").alias("target_type"), F.concat(F.lit("FEATURE::"), "feature").alias("target_key"), "supporting_modules",
        "findings", "evidence", F.round(score, 1).alias("score"), priority_level(score).alias("priority"), confidence_level(n, score).alias("confidence"))


def subgroup_investigations(norm: DataFrame, runs: DataFrame, corr: DataFrame) -> DataFrame:
    fair = ["error_bias", "bias_performance", "bias_drift", "multi_fairness_shift"]
    k = corr.filter(F.col("rule").isin(fair)).groupBy("run_id").agg(F.count(F.lit(1)).alias("_k"))
    groups = norm.filter(F.col("metric_name") == "subgroup_error_rate").select(
        "run_id", F.expr("substring(target_key, 11)").alias("grp"), F.col("metric_value").alias("_rate"))
    rows = groups.join(runs.select("run_id", "modules", "protected_attribute", "worst_disparate_impact_ratio"), "run_id").join(k, "run_id", "left")
    bias = F.array_contains("modules", "BIAS")
    found = F.coalesce("_k", F.lit(0))
    score = F.least(
        F.lit(60.0) + F.when(F.col("_rate") >= 0.15, 15.0).otherwise(0.0)
        + F.when(bias & (F.col("worst_disparate_impact_ratio") <= 0.80), 12.0).otherwise(0.0) + F.least(found * 3.0, F.lit(10.0)), F.lit(98.0))
    mods = F.when(bias, F.array(F.lit("BIAS"), F.lit("ERROR_FORENSICS"))).otherwise(F.array(F.lit("ERROR_FORENSICS")))
    attr = F.coalesce(F.when(F.trim("protected_attribute") != "", F.col("protected_attribute")), F.lit("subgroup"))
    return rows.select(
        "run_id", F.lit("SUBGROUP").alias("target_type"), F.concat(F.lit("SUBGROUP::"), attr, F.lit("="), "grp").alias("target_key"), mods.alias("supporting_modules"),
        found.alias("findings"), F.size(mods).alias("evidence"), F.round(score, 1).alias("score"), priority_level(score).alias("priority"),
        confidence_level(F.size(mods), score).alias("confidence"))


def behavior_investigations(runs: DataFrame, corr: DataFrame) -> DataFrame:
    k = corr.filter(F.col("rule") == "confidence_calibration_error").groupBy("run_id").agg(F.count(F.lit(1)).alias("_k"))
    hce = F.coalesce("high_confidence_error_rate", F.lit(0.0))
    rows = runs.filter(F.array_contains("modules", "ERROR_FORENSICS")).filter((F.coalesce("high_confidence_error_count", F.lit(0.0)) > 0) | (hce >= 0.10))
    score = F.least(F.lit(75.0) + F.least(hce * 40, F.lit(15.0)) + F.when(F.col("forensic_calibration_error") >= 0.10, 6.0).otherwise(0.0), F.lit(98.0))
    mods = F.when(F.array_contains("modules", "PERFORMANCE"), F.array(F.lit("ERROR_FORENSICS"), F.lit("PERFORMANCE"))).otherwise(F.array(F.lit("ERROR_FORENSICS")))
    return rows.join(k, "run_id", "left").select(
        "run_id", F.lit("BEHAVIOR").alias("target_type"), F.lit("BEHAVIOR::HIGH_CONFIDENCE_ERRORS").alias("target_key"), mods.alias("supporting_modules"),
        F.coalesce("_k", F.lit(0)).alias("findings"), F.size(mods).alias("evidence"), F.round(score, 1).alias("score"), priority_level(score).alias("priority"),
        confidence_level(F.size(mods), score).alias("confidence"))


def investigations(
    norm: DataFrame, wide: DataFrame | None = None, runs: DataFrame | None = None, corr: DataFrame | None = None
) -> DataFrame:
    """All investigation targets. Pass stored stages where they exist, they are read several times."""
    wide = evidence_wide(norm) if wide is None else wide
    runs = run_level(norm) if runs is None else runs
    corr = correlations(wide, runs) if corr is None else corr
    parts = [feature_investigations(wide, corr), subgroup_investigations(norm, runs, corr), behavior_investigations(runs, corr)]
    return reduce(DataFrame.unionByName, [p.select(*[F.col(c).cast("long").alias(c) if c in ("findings", "evidence") else F.col(c) for c in INVESTIGATION]) for p in parts])


def evidence_edges(inv: DataFrame, corr: DataFrame, wide: DataFrame, top: int | None = None) -> DataFrame:
    """Typed edges among modules, investigation targets and findings; ``top`` keeps the first targets of each run only, for drawing."""
    targets = inv
    if top is not None:
        # The rank filter becomes a partial top-k before the shuffle.
        order = Window.partitionBy("run_id").orderBy(F.desc("score"), "target_key")
        targets = inv.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= top).drop("_r")
    target = F.concat(F.lit("TARGET|"), F.col("target_key"))
    finding = F.concat_ws("|", F.lit("FINDING"), F.col("rule"), F.coalesce("feature", F.lit("GLOBAL")))
    edge = lambda df, kind, src, dst, w: df.select("run_id", F.lit(kind).alias("edge_type"), src.alias("source"), dst.alias("target"), w.alias("weight"))
    shown = targets.filter(F.col("target_type") == "FEATURE").select("run_id", F.expr("substring(target_key, 10)").alias("feature"), "target_key")
    hit = corr.join(shown, ["run_id", "feature"])
    linked = wide.join(shown, ["run_id", "feature"])
    module = lambda m: F.concat(F.lit("MODULE|"), m if isinstance(m, Column) else F.lit(m))
    out = [
        edge(corr.select("*", F.explode("rule_modules").alias("m")), "PRODUCES", module(F.col("m")), finding, F.col("score")),
        edge(hit, "IMPLICATES", finding, target, F.col("score")),
        edge(targets.select("*", F.explode("supporting_modules").alias("m")), "OBSERVES", module(F.col("m")), target, F.col("score")),
        edge(linked.filter(F.col("importance_rank") <= 5), "INFLUENCES", target, module("EXPLAINABILITY"), F.col("attribution_share")),
        edge(linked.filter(_c("error_enriched") | (F.col("error_association") >= 0.10)), "ASSOCIATED_WITH", target, module("ERROR_FORENSICS"), F.col("error_association")),
        edge(linked.filter((F.col("flip_rate") >= 0.02) | (F.col("sensitivity_rank") <= 3)), "SENSITIVE_UNDER", target, module("ROBUSTNESS"), F.col("flip_rate")),
    ]
    return reduce(DataFrame.unionByName, out)


def evidence_nodes(edges: DataFrame) -> DataFrame:
    """Nodes with type and degree."""
    ends = edges.select("run_id", F.col("source").alias("node")).unionByName(edges.select("run_id", F.col("target").alias("node")))
    return ends.groupBy("run_id", "node").agg(F.count(F.lit(1)).alias("degree")).withColumn("node_type", F.element_at(F.split("node", "\\|"), 1))


def dossier(norm: DataFrame, run_id: str, target_key: str) -> DataFrame:
    """Everything known about one target: the investigation, its metrics as steps, and next actions."""
    mine = norm.filter(F.col("run_id") == run_id)
    inv = investigations(mine).filter(F.col("target_key") == target_key)
    steps = mine.filter((F.col("target_key") == target_key) & F.col("metric_value").isNotNull()).select("run_id", "module", "metric_name", "metric_value")
    action = (
        F.when(F.col("module") == "DRIFT", F.lit("compare the distribution with the baseline"))
        .when(F.col("module") == "EXPLAINABILITY", F.lit("check how strongly predictions follow the feature"))
        .when(F.col("module") == "ROBUSTNESS", F.lit("test small changes of the feature"))
        .when(F.col("module") == "ERROR_FORENSICS", F.lit("read the errors in the enriched range"))
        .when(F.col("module") == "LEAKAGE", F.lit("check when the value becomes known"))
        .otherwise(F.lit("repair or impute the feature"))
    )
    text = F.format_string("%s shows evidence in %d modules (%s)", "target_key", F.size("supporting_modules"), F.concat_ws(", ", "supporting_modules"))
    return steps.join(inv, "run_id").select(
        "run_id", "target_key", "priority", "confidence", "score", text.alias("hypothesis"), "module", "metric_name", "metric_value", action.alias("next_action"))


def remediations(wide: DataFrame, runs: DataFrame, corr: DataFrame) -> DataFrame:
    """Proposed remediations, one per (run, type, target), ranked by score."""
    psi, assoc, flip, rank = _c("psi"), _c("error_association"), _c("flip_rate"), _c("importance_rank")
    leak, mi, corr_abs = _c("leakage_score"), _c("mutual_info"), F.abs("target_correlation")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    has = lambda m: F.coalesce(_c(f"in_{m}") == 1, F.lit(False))

    def cell(when: Column, kind: str, score: Column, priority: Column | str, confidence: str = "HIGH") -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("remediation_type"), score.alias("score"), _col(priority).alias("priority"), F.lit(confidence).alias("confidence")))

    quality = F.lit(65.0) + F.least(zero(_c("null_rate")) * 25, F.lit(15.0)) + F.when(_c("outlier_rate") >= 0.05, 5.0).otherwise(0.0)
    robust = F.lit(78.0) + F.least(zero(flip) * 30, F.lit(15.0))
    shift = F.lit(85.0) + F.least(psi * 4, F.lit(10.0)) + F.when(assoc >= 0.20, 4.0).otherwise(0.0)
    engineering = F.lit(80.0) + (F.lit(4) - rank) * 3.0 + F.least(zero(assoc) * 20, F.lit(10.0))
    feature_cells = [
        cell((leak >= 0.70) | (mi >= 0.50) | (corr_abs >= 0.80), "DATA_LEAKAGE_REVIEW", F.least(F.lit(88.0) + F.least(zero(leak) * 10, F.lit(10.0)), F.lit(99.0)), "CRITICAL"),
        cell((_c("null_rate") >= 0.15) | (_c("outlier_rate") >= 0.05) | (_c("is_constant") == 1), "DATA_QUALITY_REPAIR", F.least(quality, F.lit(88.0)),
             _pick(quality >= 75, "CRITICAL", "HIGH"), "MEDIUM"),
        cell((psi >= 0.25) & (has("EXPLAINABILITY") | has("ERROR_FORENSICS")), "DISTRIBUTION_SHIFT_INVESTIGATION", F.least(shift, F.lit(99.5)), "CRITICAL"),
        cell((rank <= 3) & has("ERROR_FORENSICS") & ((assoc >= 0.20) | _c("error_enriched")), "FEATURE_ENGINEERING_REVIEW", F.least(engineering, F.lit(98.0)), "CRITICAL"),
        cell((leak >= 0.70) | (_c("is_suspicious") == 1) | ((_c("null_rate") >= 0.15) & (assoc >= 0.25) & (flip >= 0.10)), "FEATURE_REMOVAL_REVIEW", F.lit(91.0), "CRITICAL"),
        cell((flip >= 0.10) | (_c("sensitivity_rank") <= 2), "ROBUSTNESS_REVIEW", F.least(robust, F.lit(94.0)), _pick(robust >= 85, "CRITICAL", "HIGH")),
    ]
    by_feature = wide.select(
        "run_id", F.lit("FEATURE").alias("target_type"), F.concat(F.lit("FEATURE::"), "feature").alias("target_key"),
        F.inline(F.filter(F.array(*feature_cells), lambda c: c.isNotNull())))
    rule = F.col("rule")
    flags = corr.groupBy("run_id").agg(
        F.bool_or(rule == "confidence_calibration_error").alias("_calibration"),
        F.bool_or(rule.isin("bias_drift", "bias_performance", "error_bias", "multi_fairness_shift")).alias("_fairness"),
        F.bool_or(rule == "multi_fragile_feature").alias("_fragile"))
    enriched = wide.groupBy("run_id").agg(F.bool_or("error_enriched").alias("_enriched"))
    rows = runs.join(flags, "run_id", "left").join(enriched, "run_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    ece = F.coalesce("expected_calibration_error", F.lit(0.0))
    calibration = F.lit(75.0) + F.least(ece * 80, F.lit(15.0))
    unfair = (_c("worst_disparate_impact_ratio") < 0.80) | (_c("equal_opportunity_gap") >= 0.10) | (_c("demographic_parity_gap") >= 0.10)
    attr = F.coalesce(F.when(F.trim("protected_attribute") != "", F.col("protected_attribute")), F.lit("protected_attribute"))

    def global_cell(when: Column, kind: str, ttype: str, key: Column | str, score: Column, priority: Column | str) -> Column:
        return F.when(when, F.struct(F.lit(ttype).alias("target_type"), _col(key).alias("target_key"), F.lit(kind).alias("remediation_type"),
                                     score.alias("score"), _col(priority).alias("priority"), F.lit("HIGH").alias("confidence")))

    global_cells = [
        global_cell((ece >= 0.08) | (_c("brier_score") >= 0.20) | flag("_calibration"), "CALIBRATION_REVIEW", "BEHAVIOR", "BEHAVIOR::CALIBRATION_FAILURE",
                    F.least(calibration, F.lit(92.0)), _pick(calibration >= 80, "CRITICAL", "HIGH")),
        global_cell(flag("_calibration") | flag("_enriched"), "ERROR_SEGMENT_REVIEW", "BEHAVIOR", "BEHAVIOR::HIGH_CONFIDENCE_ERRORS", F.lit(82.0), "HIGH"),
        global_cell(F.coalesce(unfair, F.lit(False)) | flag("_fairness"), "FAIRNESS_REVIEW", "SUBGROUP", F.concat(F.lit("SUBGROUP::"), attr), F.lit(86.0), "CRITICAL"),
        global_cell(flag("_fragile"), "MODEL_COMPLEXITY_REVIEW", "GLOBAL", "GLOBAL::MODEL_COMPLEXITY", F.lit(79.0), "HIGH"),
        global_cell(F.array_contains("modules", "ERROR_FORENSICS") | F.array_contains("modules", "PERFORMANCE"), "THRESHOLD_REVIEW", "GLOBAL",
                    "GLOBAL::THRESHOLD_TUNING", F.lit(72.0), "HIGH"),
    ]
    by_run = rows.select("run_id", F.inline(F.filter(F.array(*global_cells), lambda c: c.isNotNull())))
    both = by_feature.unionByName(by_run.select(*by_feature.columns))
    return both.dropDuplicates(["run_id", "remediation_type", "target_key"]).orderBy("run_id", F.desc("score"), "target_key", "remediation_type")


def fold_actions(rem: DataFrame, actions: DataFrame) -> DataFrame:
    """Latest select / reject decision per remediation; untouched ones stay PROPOSED."""
    keys = ["run_id", "remediation_type", "target_key"]
    last = actions.filter(F.col("action").isin("SELECT", "REJECT")).groupBy(*keys).agg(
        F.max_by("action", F.struct("acted_at", "action")).alias("_action"), F.max("acted_at").alias("decided_at"))
    status = F.when(F.col("_action") == "SELECT", F.lit("SELECTED")).when(F.col("_action") == "REJECT", F.lit("REJECTED")).otherwise(F.lit("PROPOSED"))
    return rem.join(last, keys, "left").withColumn("status", status).drop("_action")
