"""Whole audits: every module over one table pair, as metric, finding and health tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.findings import health
from ..operators import drift, explain, fairness, forensics, leakage, performance, quality, robustness
from ..operators.predicates import PREDICTION_COLUMNS, PROTECTED_COLUMNS, map_binary, numeric_features, resolve_column
from ..operators.scoring import LinearModel, Model, attribute
from ..operators.trees import TreeEnsemble
from ..session import cut_lineage
from ..sources.tables import write_partition


@dataclass
class AuditConfig:
    target: str
    prediction: str | None = None
    protected: str | None = None
    positive: str | None = None
    threshold: float = 0.5
    # For the modules that run the model: the model, a unique key, its inputs (all numeric columns by default),
    # and a function that attributes (a linear model needs none; others without one are explained by permutation).
    model: Model | None = None
    key: Sequence[str] = ()
    features: Sequence[str] | None = None
    explainer: object | None = None
    loader: bool = False
    # Text columns whose categories are compared between right and wrong predictions.
    categorical: Sequence[str] = ()
    modules: tuple[str, ...] = ("DATA_QUALITY", "LEAKAGE", "DRIFT", "PERFORMANCE", "BIAS", "ERROR_FORENSICS", "ROBUSTNESS", "EXPLAINABILITY")


@dataclass
class Audit:
    """Lazy result tables. ``modules`` tells which modules ran and why others did not.

    ``metrics`` holds numbers of the run (feature NULL) and of features (psi, attribution share and rank, flip rate ...).
    """

    run_id: str
    findings: DataFrame
    health: DataFrame
    metrics: DataFrame
    modules: DataFrame


# Shape of the result tables where no module has anything to tell.
EMPTY = {
    "findings": "module string, feature string, code string, severity string, metric string, value double, threshold double, advice string",
    "health": "module string, n_findings long, health_score double, passed boolean",
    "metrics": "module string, feature string, metric_name string, metric_value double",
}


def run_audit(run_id: str, evaluation: DataFrame, config: AuditConfig, baseline: DataFrame | None = None) -> Audit:
    """Plan all requested modules; a module whose inputs are absent is SKIPPED, one that fails to plan is FAILED."""
    spark = evaluation.sparkSession
    p = config.prediction or resolve_column(evaluation, PREDICTION_COLUMNS)
    attr = config.protected or resolve_column(evaluation, PROTECTED_COLUMNS)
    findings, scores, metrics, status = [], [], [], []

    def add(module: str, found: DataFrame, score: DataFrame, *values: DataFrame) -> None:
        findings.append(found.withColumn("module", F.lit(module)))
        scores.append(score.select(F.lit(module).alias("module"), "n_findings", "health_score", "passed"))
        for part in values:
            numbers = [f.name for f in part.schema if f.dataType.typeName() in ("double", "long", "integer")]
            cells = F.array(*[F.struct(F.lit(n).alias("metric_name"), F.col(n).cast("double").alias("metric_value")) for n in numbers])
            who = F.col("feature").cast("string") if "feature" in part.columns else F.lit(None).cast("string")
            metrics.append(part.select(F.lit(module).alias("module"), who.alias("feature"), F.inline(cells)))

    def labelled() -> DataFrame:
        return map_binary(evaluation, config.target, config.positive, "_label")

    def data_quality():
        found = quality.quality_findings(evaluation)
        add("DATA_QUALITY", found, quality.quality_health(found), quality.dataset_overview(evaluation))

    def leak():
        features = [c for c in evaluation.columns if c not in (config.target, p, *config.key)]
        found = leakage.leakage_findings(evaluation, config.target, baseline, features)
        add("LEAKAGE", found, leakage.leakage_health(found))

    def shift():
        feats, schema = drift.drift_features(baseline, evaluation), drift.schema_drift(baseline, evaluation)
        found = drift.drift_findings(feats, schema)
        add("DRIFT", found, health(found, drift.PENALTIES), drift.drift_report(feats, schema).drop("health_score", "passed", "n_findings", "n_critical"), feats)

    def perform():
        rows = labelled()
        values = performance.performance_metrics(rows, "_label", p, config.threshold)
        found = performance.performance_findings(values, performance.prediction_audit(rows, "_label", p))
        add("PERFORMANCE", found, health(found, performance.PENALTIES), values)

    def fair():
        gm = fairness.group_metrics(labelled(), "_label", p, attr, config.threshold)
        found = fairness.fairness_findings(gm)
        add("BIAS", found, fairness.fairness_health(found), fairness.fairness_summary(gm))

    def errors():
        et = forensics.evaluation_table(labelled(), "_label", p, config.threshold)
        found = forensics.forensics_findings(et, numeric_features(evaluation, [config.target, p, *config.key]), config.categorical, attr)
        report = forensics.forensics_report(et, found)
        add("ERROR_FORENSICS", found, report, report.drop("health_score", "passed", "n_findings"))

    inputs = list(config.features or numeric_features(evaluation, [config.target, p, *config.key]))

    def robust():
        rows, key = labelled(), list(config.key)
        scales = robustness.scale_map(rows, inputs)
        run = {"t": config.threshold, "loader": config.loader, "scales": scales}
        jitter = robustness.jitter_sensitivity(rows, config.model, inputs, key, "_label", **run)
        groups = robustness.subgroup_robustness(rows, config.model, inputs, key, attr, **run) if attr else None
        found = robustness.robustness_findings(jitter, robustness.boundary_distances(rows, config.model, inputs, key, **run), groups)
        add("ROBUSTNESS", found, robustness.robustness_report(found), jitter, robustness.feature_sensitivity(rows, config.model, inputs, key, **run))

    def explained():
        rows, key = labelled(), list(config.key)
        explainer = config.explainer or (config.model if isinstance(config.model, (LinearModel, TreeEnsemble)) else None)
        permuted = cut_lineage(explain.permutation_importance(rows, config.model, "_label", inputs, key, repeats=3, loader=config.loader))
        importance, agreement = explain.importance_shares(permuted), None
        if explainer is not None:
            importance = cut_lineage(explain.global_attribution(attribute(rows, explainer, inputs, key)))
            agreement = explain.rank_agreement(importance, permuted)
        spread = quality.numeric_summary(rows, inputs).select("feature", "std")
        found = explain.explain_findings(importance, agreement, spread)
        add("EXPLAINABILITY", found, explain.explain_report(found), explain.concentration(importance), importance)

    needs = {"DATA_QUALITY": (), "LEAKAGE": (), "DRIFT": ("baseline",), "PERFORMANCE": ("prediction",), "BIAS": ("prediction", "protected"), "ERROR_FORENSICS": ("prediction",),
             "ROBUSTNESS": ("model", "key"), "EXPLAINABILITY": ("model", "key")}
    have = {"baseline": baseline is not None, "prediction": p is not None, "protected": attr is not None, "model": config.model is not None, "key": bool(config.key)}
    steps = {"DATA_QUALITY": data_quality, "LEAKAGE": leak, "DRIFT": shift, "PERFORMANCE": perform, "BIAS": fair, "ERROR_FORENSICS": errors,
             "ROBUSTNESS": robust, "EXPLAINABILITY": explained}
    for module in config.modules:
        lacking = [n for n in needs[module] if not have[n]]
        if lacking:
            status.append((run_id, module, "SKIPPED", "no " + ", ".join(lacking)))
            continue
        try:
            steps[module]()
            status.append((run_id, module, "COMPLETED", None))
        except Exception as error:  # noqa: BLE001 - one module must not stop the others
            status.append((run_id, module, "FAILED", str(error).split("\n")[0]))
    every = lambda name, parts: reduce(
        DataFrame.unionByName, parts or [spark.createDataFrame([], EMPTY[name])]).withColumn("run_id", F.lit(run_id))
    return Audit(run_id, every("findings", findings), every("health", scores), every("metrics", metrics), spark.createDataFrame(status, "run_id string, module string, status string, reason string"))


def store_audit(audit: Audit, folder: str) -> None:
    """Write the result tables, replacing an earlier execution of the same run."""
    for name in ("findings", "health", "metrics", "modules"):
        write_partition(getattr(audit, name), f"{folder.rstrip('/')}/{name}", ["run_id"], [audit.run_id])
