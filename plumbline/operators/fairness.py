"""Group fairness against a reference group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, ratio, wilson
from ..functions.findings import Rule, apply_rules, health
from .predicates import fairness_rows

THRESHOLDS = {
    "dir_low_critical": 0.70,
    "dir_low_warning": 0.80,
    "dir_high_warning": 1.25,
    "dir_high_critical": 1.43,
    "dp_critical": 0.20,
    "dp_warning": 0.10,
    "tpr_critical": 0.10,
    "tpr_warning": 0.05,
    "fpr_critical": 0.10,
    "calibration": 0.10,
    "group_size": 30,
    "groups_warning": 20,
    "groups_critical": 50,
}
PENALTIES = {"CRITICAL": 25, "HIGH": 15, "WARNING": 5, "MEDIUM": 3, "LOW": 1}


def group_metrics(df: DataFrame, y: str, p: str, attr: str, t: float = 0.5, minimum: int = 30) -> DataFrame:
    """Confusion cells, rates and Wilson bounds of every group in one aggregate."""
    rows = fairness_rows(df, y, attr, p)
    hit, pos = col(p) >= t, col(y) == 1
    g = rows.groupBy(col(attr).cast("string").alias("grp")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(hit & pos).alias("tp"),
        F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & ~pos).alias("tn"),
        F.count_if(~hit & pos).alias("fn"),
        F.avg(col(p).cast("double")).alias("mean_p"),
    )
    n, tp, fp, tn, fn = (F.col(c) for c in ("n", "tp", "fp", "tn", "fn"))
    bounds = {"selection": wilson(tp + fp, n), "tpr": wilson(tp, tp + fn), "fpr": wilson(fp, fp + tn)}
    return g.select(
        "grp", "n", "tp", "fp", "tn", "fn",
        ratio(tp + fp, n).alias("selection_rate"),
        ratio(tp + fn, n).alias("base_rate"),
        ratio(tp, tp + fn).alias("tpr"),
        ratio(fn, tp + fn).alias("fnr"),
        ratio(tn, tn + fp).alias("tnr"),
        ratio(fp, tn + fp).alias("fpr"),
        ratio(tp, tp + fp).alias("ppv"),
        ratio(tn, tn + fn).alias("npv"),
        ratio(tp + tn, n).alias("accuracy"),
        "mean_p",
        (n < minimum).alias("is_small"),
        *[b.alias(f"{name}_{side}") for name, pair in bounds.items() for side, b in zip(("low", "high"), pair)],
    )


def reference_group(gm: DataFrame, configured: str | None = None) -> DataFrame:
    """One row: the configured group where present, else the largest (ties: smallest name)."""
    wanted = F.lit(configured)
    order = F.struct(F.coalesce(F.col("grp") != wanted, F.lit(True)), -F.col("n"), F.col("grp"))
    return gm.agg(F.min_by(F.struct("grp", "selection_rate", "tpr", "fpr"), order).alias("r")).select(
        F.col("r.grp").alias("ref_grp"),
        F.col("r.selection_rate").alias("ref_selection"),
        F.col("r.tpr").alias("ref_tpr"),
        F.col("r.fpr").alias("ref_fpr"),
    )


def _with_reference(gm: DataFrame, configured: str | None) -> DataFrame:
    # One row against at most a few dozen groups.
    return gm.join(F.broadcast(reference_group(gm, configured)))


def demographic_parity(gm: DataFrame, configured: str | None = None) -> DataFrame:
    diff = F.col("selection_rate") - F.col("ref_selection")
    return _with_reference(gm, configured).select(
        "grp", "selection_rate", F.col("ref_selection").alias("reference_rate"), diff.alias("difference"), F.abs(diff).alias("gap")
    )


def disparate_impact(gm: DataFrame, configured: str | None = None) -> DataFrame:
    dir_ = F.try_divide(F.col("selection_rate"), F.col("ref_selection"))
    t = THRESHOLDS
    return _with_reference(gm, configured).select(
        "grp",
        (F.col("grp") == F.col("ref_grp")).alias("is_reference"),
        dir_.alias("impact_ratio"),
        F.coalesce((dir_ < t["dir_low_warning"]) | (dir_ > t["dir_high_warning"]), F.lit(False)).alias("violates_rule"),
    )


def equalized_odds(gm: DataFrame, configured: str | None = None) -> DataFrame:
    tpr, fpr = F.col("tpr") - F.col("ref_tpr"), F.col("fpr") - F.col("ref_fpr")
    return _with_reference(gm, configured).select(
        "grp", tpr.alias("tpr_difference"), F.abs(tpr).alias("tpr_gap"), fpr.alias("fpr_difference"), F.abs(fpr).alias("fpr_gap")
    )


def group_calibration(gm: DataFrame) -> DataFrame:
    gap = F.col("mean_p") - F.col("base_rate")
    return gm.select("grp", "mean_p", "base_rate", gap.alias("calibration_gap"), F.abs(gap).alias("absolute_gap"))


def fairness_summary(gm: DataFrame, configured: str | None = None) -> DataFrame:
    """Largest gaps over groups and the worst impact ratio below 1."""
    spread = lambda c: F.max(c) - F.min(c)
    dir_ = F.try_divide(F.col("selection_rate"), F.col("ref_selection"))
    below = F.when((F.col("grp") != F.col("ref_grp")) & (dir_ < 1), dir_)
    return _with_reference(gm, configured).agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("n").alias("n_rows"),
        F.count_if("is_small").alias("small_groups"),
        F.max("ref_grp").alias("reference"),
        spread("selection_rate").alias("dp_gap"),
        F.coalesce(spread("tpr"), F.lit(0.0)).alias("tpr_gap"),
        F.coalesce(spread("fpr"), F.lit(0.0)).alias("fpr_gap"),
        F.greatest(F.coalesce(spread("tpr"), F.lit(0.0)), F.coalesce(spread("fpr"), F.lit(0.0))).alias("odds_gap"),
        F.max(F.abs(F.col("mean_p") - F.col("base_rate"))).alias("calibration_gap"),
        F.coalesce(F.min(below), F.lit(1.0)).alias("worst_impact_ratio"),
        F.coalesce(F.min_by("grp", F.when(below.isNotNull(), F.struct(below, F.col("grp")))), F.max("ref_grp")).alias(
            "worst_impact_group"
        ),
    )


def worst_groups(gm: DataFrame, configured: str | None = None) -> DataFrame:
    name = F.col("grp")

    def lowest(c):
        return F.min_by(name, F.when(c.isNotNull(), F.struct(c, name)))

    dir_ = F.try_divide(F.col("selection_rate"), F.col("ref_selection"))
    below = F.when((name != F.col("ref_grp")) & (dir_ < 1), dir_)
    return _with_reference(gm, configured).agg(
        lowest(F.col("selection_rate")).alias("lowest_selection"),
        lowest(F.col("tpr")).alias("lowest_tpr"),
        lowest(-F.col("fpr")).alias("highest_fpr"),
        F.coalesce(lowest(below), F.max("ref_grp")).alias("worst_impact"),
    )


def fairness_guards(df: DataFrame, y: str, p: str, attr: str) -> DataFrame:
    """Group count checks and whether predictions can be read as probabilities."""
    rows = fairness_rows(df, y, attr, p)
    per = rows.groupBy(col(attr).alias("g")).agg(
        F.count(F.lit(1)).alias("n"), F.min(col(p).cast("double")).alias("lo"), F.max(col(p).cast("double")).alias("hi"),
        F.count_if((col(p) > 0) & (col(p) < 1)).alias("inner"),
    )
    t = THRESHOLDS
    groups = F.col("n_groups")
    return per.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count_if(F.col("n") < t["group_size"]).alias("small_groups"),
        F.coalesce((F.min("lo") >= 0) & (F.max("hi") <= 1) & (F.sum("inner") > 0), F.lit(False)).alias("has_probabilities"),
    ).withColumn(
        "status",
        F.when(F.col("n_rows") < 2, F.lit("TOO_FEW_ROWS"))
        .when(groups < 2, F.lit("SINGLE_GROUP"))
        .when(groups > t["groups_critical"], F.lit("TOO_MANY_GROUPS"))
        .when(groups > t["groups_warning"], F.lit("MANY_GROUPS"))
        .otherwise(F.lit("OK")),
    )


def fairness_findings(gm: DataFrame, configured: str | None = None, thresholds: dict | None = None) -> DataFrame:
    t = {**THRESHOLDS, **(thresholds or {})}
    d = F.col("impact_ratio")
    by_group = [
        Rule("impact_critical", "HIGH", ~F.col("is_reference") & (d < t["dir_low_critical"]), "impact_ratio", d, t["dir_low_critical"],
             "review the decision rule for this group"),
        Rule("impact_low", "WARNING", ~F.col("is_reference") & (d >= t["dir_low_critical"]) & (d < t["dir_low_warning"]), "impact_ratio",
             d, t["dir_low_warning"], "watch the selection rate"),
        Rule("impact_high", "HIGH", ~F.col("is_reference") & (d > t["dir_high_critical"]), "impact_ratio", d, t["dir_high_critical"],
             "the reference group is selected less often"),
    ]
    dp, tpr, fpr, cal = (F.col(c) for c in ("dp_gap", "tpr_gap", "fpr_gap", "calibration_gap"))
    overall = [
        Rule("parity_critical", "HIGH", dp >= t["dp_critical"], "dp_gap", dp, t["dp_critical"], "look for proxies of the attribute"),
        Rule("parity_elevated", "WARNING", (dp >= t["dp_warning"]) & (dp < t["dp_critical"]), "dp_gap", dp, t["dp_warning"], "watch the gap"),
        Rule("opportunity_critical", "HIGH", tpr >= t["tpr_critical"], "tpr_gap", tpr, t["tpr_critical"], "compare thresholds per group"),
        Rule("opportunity_elevated", "WARNING", (tpr >= t["tpr_warning"]) & (tpr < t["tpr_critical"]), "tpr_gap", tpr, t["tpr_warning"],
             "watch recall per group"),
        Rule("odds_critical", "HIGH", fpr >= t["fpr_critical"], "fpr_gap", fpr, t["fpr_critical"], "compare false alarms per group"),
        Rule("small_groups", "WARNING", F.col("small_groups") > 0, "small_groups", F.col("small_groups"), 0.0, "collect more rows"),
        Rule("calibration_gap", "WARNING", cal >= t["calibration"], "calibration_gap", cal, t["calibration"], "calibrate per group"),
        Rule("many_groups", "WARNING", (F.col("n_groups") > t["groups_warning"]) & (F.col("n_groups") <= t["groups_critical"]),
             "n_groups", F.col("n_groups"), t["groups_warning"], "merge small groups"),
        Rule("too_many_groups", "CRITICAL", F.col("n_groups") > t["groups_critical"], "n_groups", F.col("n_groups"), t["groups_critical"],
             "choose an attribute with fewer values"),
    ]
    return apply_rules(disparate_impact(gm, configured), "FAIRNESS", by_group, F.col("grp")).unionByName(
        apply_rules(fairness_summary(gm, configured), "FAIRNESS", overall)
    )


def fairness_health(findings: DataFrame) -> DataFrame:
    """Health of the findings; an attribute with too many groups leaves no score at all."""
    blocked = findings.agg(F.count_if(F.col("code") == "too_many_groups").alias("_blocked"))
    return health(findings, PENALTIES).join(F.broadcast(blocked)).select(
        "n_findings", "n_critical", F.when(F.col("_blocked") > 0, F.lit(0.0)).otherwise(F.col("health_score")).alias("health_score"), "passed"
    )


def fairness_report(df: DataFrame, y: str, p: str, attr: str, t: float = 0.5, configured: str | None = None) -> DataFrame:
    """Summary row plus health; passing also needs the worst impact ratio at .70."""
    gm = group_metrics(df, y, p, attr, t)
    scored = fairness_health(fairness_findings(gm, configured))
    out = fairness_summary(gm, configured).join(F.broadcast(scored))
    return out.withColumn("passed", F.col("passed") & (F.col("worst_impact_ratio") >= 0.70))
