"""Turn stored module results (JSON per run and module) into one tall metric table.

Output: run_id, module, metric_name, target_type, target_key, metric_value, label.
Several spellings of a field are accepted; the first one present wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUT = ["run_id", "module", "metric_name", "target_type", "target_key", "metric_value", "label"]

# Run-level fields, canonical name -> JSON paths in order of preference.
RUN_FIELDS: dict[str, dict[str, list[str]]] = {
    "DATA_QUALITY": {
        "missing_rate": ["summary.globalMissingRate"],
        "duplicate_row_count": ["summary.duplicateRowCount"],
        "constant_column_count": ["summary.constantColumnCount", "summary.constantColumnsCount"],
    },
    "LEAKAGE": {},
    "DRIFT": {
        "max_psi": ["summary.maxPsi"],
        "drifted_feature_count": ["summary.driftedFeatureCount", "summary.practicalDriftCount"],
        "mean_wasserstein": ["summary.meanWasserstein", "summary.avgWasserstein"],
    },
    "PERFORMANCE": {
        "roc_auc": ["summary.rocAuc"],
        "pr_auc": ["summary.prAuc"],
        "f1": ["summary.f1"],
        "accuracy": ["summary.accuracy"],
        "precision": ["summary.precision"],
        "recall": ["summary.recall"],
        "false_negative_rate": ["summary.falseNegativeRate"],
        "false_positive_rate": ["summary.falsePositiveRate"],
        "expected_calibration_error": ["summary.expectedCalibrationError"],
        "log_loss": ["summary.logLoss"],
        "brier_score": ["summary.brierScore"],
    },
    "EXPLAINABILITY": {
        "top1_attribution_share": ["summary.top1AttributionShare"],
        "top3_attribution_share": ["summary.top3AttributionShare"],
    },
    "BIAS": {
        "demographic_parity_gap": ["summary.demographicParityGap"],
        "worst_disparate_impact_ratio": ["summary.disparateImpactRatio", "summary.worstDisparateImpactRatio"],
        "equal_opportunity_gap": ["summary.equalOpportunityGap"],
        "group_calibration_gap": ["summary.worstCalibrationGap"],
    },
    "ROBUSTNESS": {
        "gaussian_jitter_5pct_flip_rate": ["summary.gaussianJitter5PctFlipRate"],
        "boundary_flip_rate": ["summary.boundaryFlipRate"],
    },
    "ERROR_FORENSICS": {
        "total_errors": ["errorSummary.totalErrors", "summary.totalErrors"],
        "overall_error_rate": ["errorSummary.errorRate", "errorSummary.overallErrorRate", "summary.overallErrorRate"],
        "high_confidence_error_count": ["confidenceAnalysis.highConfidenceErrorCount", "summary.highConfidenceErrorCount"],
        "high_confidence_error_rate": ["confidenceAnalysis.highConfidenceErrorRate", "summary.highConfidenceErrorRate"],
        "false_positive_count": ["errorSummary.falsePositive.count", "summary.fpCount"],
        "false_negative_count": ["errorSummary.falseNegative.count", "summary.fnCount"],
        "subgroup_disparity_ratio": ["summary.worstSubgroupDisparityRatio"],
        "forensic_calibration_error": ["calibrationForensics.expectedCalibrationError"],
    },
}
# Labels kept beside the numbers.
RUN_LABELS = {"BIAS": {"protected_attribute": ["summary.protectedAttribute"]}}

# Feature lists and their fields. A field may hold a path into a nested object.
FEATURE_LISTS: dict[str, list[tuple[list[str], dict[str, list[str]]]]] = {
    "DATA_QUALITY": [(["columns"], {
        "null_rate": ["nullRate", "missingRate"],
        "outlier_rate": ["outlierRate"],
        "is_constant": ["constant", "isConstant"],
        "distinct_count": ["distinctCount", "uniqueCount"],
    })],
    "LEAKAGE": [(["features"], {
        "mutual_info": ["mutualInfo", "mutualInformation"],
        "target_correlation": ["pearsonCorrelation", "correlation", "targetAssociation"],
        "leakage_score": ["leakageScore", "suspicionScore"],
        "is_suspicious": ["isSuspicious", "isPotentialLeakage"],
    })],
    "DRIFT": [(["features", "columns"], {
        "psi": ["psi"],
        "ks_p": ["ksPValue", "ks/p_value"],
        "ks_statistic": ["ksStatistic", "ks/statistic"],
        "wasserstein": ["wasserstein/distance", "wasserstein"],
        "drift_detected": ["driftDetected"],
    })],
    "EXPLAINABILITY": [(["globalImportance", "attributions", "features"], {
        "importance_rank": ["rank"],
        "mean_abs_attribution": ["meanAbsoluteShap", "meanAbsShap", "importance"],
        "attribution_share": ["attributionShare"],
    })],
    "ROBUSTNESS": [(["featureSensitivity.features", "featureSensitivities", "features"], {
        "sensitivity_rank": ["sensitivityRank"],
        "flip_rate": ["predictionFlipRate", "flipRate", "perturbationFlipRate"],
        "mean_probability_shift": ["meanProbabilityShift"],
    })],
    "ERROR_FORENSICS": [
        (["featureAssociations"], {
            "error_correlation": ["statistic", "value"],
            "error_association": ["effectSize", "absoluteAssociation"],
            "error_p": ["adjustedPValue", "rawPValue"],
        }),
        (["falsePositiveAnalysis.topSeparations", "falsePositiveAnalysis.topFeatureDifferences"], {
            "fp_separation": ["standardizedMeanDifference", "absoluteSeparation"],
        }),
        (["falseNegativeAnalysis.topSeparations", "falseNegativeAnalysis.topFeatureDifferences"], {
            "fn_separation": ["standardizedMeanDifference", "absoluteSeparation"],
        }),
    ],
}
# Lists without an explicit rank are already in rank order.
RANKED = {"importance_rank", "sensitivity_rank"}


def _json(path: str) -> Column:
    return F.get_json_object("result_json", "$." + path)


def _number(text: Column) -> Column:
    """Number, or 1 / 0 for JSON booleans."""
    return F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(text.try_cast("double"))


def _field(m: Column, spelling: str) -> Column:
    if "/" in spelling:
        head, tail = spelling.split("/")
        inner = F.try_element_at(m, F.lit(head))
        return F.when(inner.startswith("{"), F.get_json_object(inner, "$." + tail))
    return F.try_element_at(m, F.lit(spelling))


def _cell(name: str | Column, target_type: str, key: Column, value: Column, label: Column | None = None) -> Column:
    return F.struct(
        (F.lit(name) if isinstance(name, str) else name).alias("metric_name"),
        F.lit(target_type).alias("target_type"),
        key.alias("target_key"),
        value.cast("double").alias("metric_value"),
        (F.lit(None) if label is None else label).cast("string").alias("label"),
    )


def normalize_results(results: DataFrame) -> DataFrame:
    """``results``: run_id, module, status, result_json. Only completed results count.

    Every row is turned into its metrics in one projection: one scan, no shuffle.
    """
    done = results.filter((F.col("status") == "COMPLETED") & F.col("result_json").isNotNull() & (F.trim("result_json") != ""))
    cells = F.lit(None)
    for module in RUN_FIELDS:
        parts = [_run_cells(module)] + [_feature_cells(paths, fields) for paths, fields in FEATURE_LISTS.get(module, [])]
        if module == "ERROR_FORENSICS":
            parts.append(_subgroup_cells())
        cells = F.when(F.col("module") == module, F.concat(*parts)).otherwise(cells)
    out = done.select("run_id", "module", F.inline(cells))
    return out.select(*OUT).filter(F.col("metric_value").isNotNull() | F.col("label").isNotNull())


def _run_cells(module: str) -> Column:
    everywhere = F.lit("GLOBAL")
    common = {"health_score": ["summary.healthScore", "summary.overallHealth"], "passed": ["summary.passed"]}
    # The marker row says that the module took part, even when it measured nothing.
    cells = [_cell("completed", "GLOBAL", everywhere, F.lit(1.0))]
    for name, paths in {**RUN_FIELDS[module], **common}.items():
        cells.append(_cell(name, "GLOBAL", everywhere, F.coalesce(*[_number(_json(p)) for p in paths])))
    for name, paths in RUN_LABELS.get(module, {}).items():
        cells.append(_cell(name, "GLOBAL", everywhere, F.lit(None), F.coalesce(*[_json(p) for p in paths])))
    if module == "ERROR_FORENSICS":
        bins = F.from_json(_json("calibrationForensics.bins"), "array<map<string,string>>")
        bad = lambda b: (F.try_element_at(b, F.lit("isHighError")) == "true") | (F.try_element_at(b, F.lit("isSevereGap")) == "true")
        cells.append(_cell("severe_calibration_bins", "GLOBAL", everywhere, F.when(bins.isNotNull(), F.size(F.filter(bins, bad)))))
    return F.array(*cells)


def _entries(paths: list[str]) -> Column:
    """Array of (name, place, m): list elements, or entries of an object keyed by feature."""
    text = F.coalesce(*[_json(p) for p in paths])
    fields = "array<map<string,string>>"
    as_list = F.transform(F.from_json(text, fields), lambda m, i: F.struct(
        F.coalesce(F.try_element_at(m, F.lit("feature")), F.try_element_at(m, F.lit("name"))).alias("name"), i.alias("place"), m.alias("m")))
    as_map = F.transform(F.map_entries(F.from_json(text, "map<string,map<string,string>>")), lambda e: F.struct(
        e["key"].alias("name"), F.lit(None).cast("int").alias("place"), e["value"].alias("m")))
    both = F.when(text.startswith("["), as_list).when(text.startswith("{"), as_map)
    return F.filter(both, lambda e: e["name"].isNotNull() & (F.trim(e["name"]) != ""))


def _feature_cells(paths: list[str], fields: dict[str, list[str]]) -> Column:
    def cells(e: Column) -> Column:
        out = []
        for name, spellings in fields.items():
            value = F.coalesce(*[_number(_field(e["m"], s)) for s in spellings])
            if name in RANKED:
                value = F.coalesce(value, (e["place"] + 1).cast("double"))
            if name == "error_association":
                value = F.abs(F.coalesce(value, *[_number(_field(e["m"], s)) for s in fields["error_correlation"]]))
            out.append(_cell(name, "FEATURE", F.concat(F.lit("FEATURE::"), e["name"]), value))
        return F.array(*out)

    return F.coalesce(F.flatten(F.transform(_entries(paths), cells)), _none())


def _subgroup_cells() -> Column:
    """Error rate per subgroup."""
    groups = F.from_json(_json("subgroupAnalysis"), "array<map<string,string>>")
    name = lambda m: F.coalesce(F.try_element_at(m, F.lit("group")), F.try_element_at(m, F.lit("subgroup")))
    named = F.filter(groups, lambda m: name(m).isNotNull() & (F.trim(name(m)) != ""))
    rows = F.transform(named, lambda m: _cell(
        "subgroup_error_rate", "SUBGROUP", F.concat(F.lit("SUBGROUP::"), name(m)), _number(F.try_element_at(m, F.lit("errorRate")))))
    return F.coalesce(rows, _none())


def _none() -> Column:
    return F.array().cast("array<struct<metric_name:string,target_type:string,target_key:string,metric_value:double,label:string>>")
