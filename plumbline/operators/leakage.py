"""Target leakage and train/evaluation contamination."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, finite, missing, numeric_columns, ratio, row_key
from ..functions.findings import Rule, apply_rules, health
from .association import correlation_ratio, cramers_v, mutual_information, pearson

THRESHOLDS = {
    "mi_critical": 0.70,
    "mi_high": 0.50,
    "mi_medium": 0.30,
    "assoc_critical": 0.85,
    "assoc_high": 0.65,
    "assoc_medium": 0.40,
    "overlap_warning": 0.001,
    "overlap_critical": 0.02,
}
PENALTIES = {"CRITICAL": 30, "HIGH": 15, "WARNING": 8, "MEDIUM": 4}


def target_profile(df: DataFrame, y: str) -> DataFrame:
    """Task type, sample size and number of classes of the target."""
    counts = df.filter(~missing(df, y)).groupBy(col(y).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    continuous = isinstance(df.schema[y].dataType, (T.FloatType, T.DoubleType, T.DecimalType))
    d = F.col("n_classes")
    task = (
        F.when(d < 2, F.lit("UNKNOWN"))
        .when(d == 2, F.lit("BINARY_CLASSIFICATION"))
        .when(F.lit(continuous) & (d > 20), F.lit("REGRESSION"))
        .otherwise(F.lit("MULTICLASS_CLASSIFICATION"))
    )
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_classes")).withColumn("task", task)


def class_balance(df: DataFrame, y: str) -> DataFrame:
    counts = df.filter(~missing(df, y)).groupBy(col(y).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("_all"))
    return counts.join(F.broadcast(whole)).select("class", "n", ratio(F.col("n"), F.col("_all")).alias("share"))


def target_association(df: DataFrame, y: str, columns: Sequence[str] | None = None, task: str | None = None) -> DataFrame:
    """feature, measure, association, n: the measure follows from feature type and task."""
    names = [c for c in (columns or df.columns) if c != y]
    if task is None:
        task = target_profile(df, y).first()["task"]
    numbers = [c for c in numeric_columns(df) if c in names]
    others = [c for c in names if c not in numbers]
    text_target = not isinstance(df.schema[y].dataType, (T.NumericType, T.BooleanType))
    label = F.when(~missing(df, y), col(y))
    parts = []
    if numbers:
        if task == "REGRESSION" or (task == "BINARY_CLASSIFICATION" and not text_target):
            number = label.cast("double") if not isinstance(df.schema[y].dataType, T.BooleanType) else label.cast("int").cast("double")
            parts.append(pearson(df, numbers, number).select("feature", F.lit("PEARSON").alias("measure"), F.col("r").alias("association"), "n"))
        else:
            eta = correlation_ratio(df, {c: label for c in numbers}, {c: finite(col(c)) for c in numbers})
            parts.append(eta.select("feature", F.lit("CORRELATION_RATIO").alias("measure"), F.col("eta").alias("association"), "n"))
    if others:
        if task == "REGRESSION":
            groups = {c: F.when(~missing(df, c), col(c)) for c in others}
            eta = correlation_ratio(df, groups, {c: finite(label) for c in others})
            parts.append(eta.select("feature", F.lit("CORRELATION_RATIO").alias("measure"), F.col("eta").alias("association"), "n"))
        else:
            v = cramers_v(df, others, label)
            parts.append(v.select("feature", F.lit("CRAMERS_V").alias("measure"), F.col("cramers_v").alias("association"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(
        "feature",
        F.when(F.col("association").isNull(), F.lit("NONE")).otherwise(F.col("measure")).alias("measure"),
        F.coalesce("association", F.lit(0.0)).alias("association"),
        "n",
    )


def leakage_rank(
    df: DataFrame, y: str, columns: Sequence[str] | None = None, bins: int = 20, thresholds: dict | None = None
) -> DataFrame:
    """Features by suspicion = .60 mutual information + .40 |association|, with a risk tier."""
    t = {**THRESHOLDS, **(thresholds or {})}
    names = [c for c in (columns or df.columns) if c != y]
    task = target_profile(df, y).first()["task"]
    assoc = target_association(df, y, names, task)
    label = F.when(~missing(df, y), col(y))
    if task == "REGRESSION":
        from .association import quantile_codes

        label = quantile_codes(df, [y], bins)[y]
    mi = mutual_information(df, names, label, bins)
    m, a = F.coalesce("mi", F.lit(0.0)), F.abs("association")
    risk = F.lit("LOW")
    for tier in ("medium", "high", "critical"):
        risk = F.when((m >= t[f"mi_{tier}"]) | (a >= t[f"assoc_{tier}"]), F.lit(tier.upper())).otherwise(risk)
    return (
        assoc.join(F.broadcast(mi.select("feature", "mi")), "feature", "left")
        .select(
            "feature",
            m.alias("mi"),
            "measure",
            "association",
            "n",
            risk.alias("risk"),
            ((m >= 0.75) | (a >= 0.85)).alias("is_proxy"),
            (m * 0.60 + a * 0.40).alias("suspicion"),
        )
        .orderBy(F.desc("suspicion"), "feature")
    )


def sample_overlap(evaluation: DataFrame, baseline: DataFrame) -> DataFrame:
    """Distinct evaluation rows that also occur in the baseline (all common columns).

    One union and one hash aggregate: each fingerprint carries which sides it
    was seen on, so repeated rows are combined before the shuffle.
    """
    common = [c for c in evaluation.columns if c in set(baseline.columns)]
    e, b = evaluation.select(*map(col, common)), baseline.select(*map(col, common))
    keys = e.select(row_key(e).alias("k"), F.lit(True).alias("in_eval")).unionByName(
        b.select(row_key(b).alias("k"), F.lit(False).alias("in_eval"))
    )
    seen = keys.groupBy("k").agg(F.bool_or("in_eval").alias("e"), F.bool_or(~F.col("in_eval")).alias("b"))
    out = seen.agg(
        F.count_if("e").alias("distinct_eval"),
        F.count_if(F.col("e") & F.col("b")).alias("overlap_count"),
    )
    rate = ratio(F.col("overlap_count"), F.col("distinct_eval"), 0)
    return out.select(
        "distinct_eval",
        "overlap_count",
        rate.alias("overlap_rate"),
        F.when(rate >= THRESHOLDS["overlap_critical"], F.lit("CRITICAL"))
        .when(rate >= THRESHOLDS["overlap_warning"], F.lit("WARNING"))
        .alias("severity"),
    )


def overlapping_rows(evaluation: DataFrame, baseline: DataFrame) -> DataFrame:
    """Evaluation rows whose fingerprint occurs in the baseline (left semi join)."""
    common = [c for c in evaluation.columns if c in set(baseline.columns)]
    b = baseline.select(*map(col, common))
    e = evaluation.withColumn("_k", row_key(evaluation.select(*map(col, common))))
    return e.join(b.select(row_key(b).alias("_k")).distinct(), "_k", "left_semi").drop("_k")


def leakage_findings(
    df: DataFrame,
    y: str,
    baseline: DataFrame | None = None,
    columns: Sequence[str] | None = None,
    bins: int = 20,
    thresholds: dict | None = None,
) -> DataFrame:
    t = {**THRESHOLDS, **(thresholds or {})}
    spark = df.sparkSession
    blank = spark.range(1)

    def only(code: str, severity: str, advice: str) -> DataFrame:
        rule = Rule(code, severity, F.lit(True), "target", F.lit(0.0), None, advice)
        return apply_rules(blank, "LEAKAGE", [rule], F.lit(y))

    if y not in df.columns:
        return only("target_missing", "CRITICAL", "name an existing target column")
    profile = target_profile(df, y).first()
    if profile["n_rows"] == 0 or profile["n_classes"] < 2:
        return only("target_constant", "CRITICAL", "the target needs at least two values")
    names = [c for c in (columns or df.columns) if c != y]
    if not names:
        return only("no_features", "INFO", "add candidate features")
    risk, m, a = F.col("risk"), F.col("mi"), F.col("association")
    rules = [
        Rule("leak_critical", "CRITICAL", risk == "CRITICAL", "suspicion", F.col("suspicion"), t["assoc_critical"],
             "confirm that the value exists before prediction time, else drop it"),
        Rule("leak_high", "HIGH", risk == "HIGH", "suspicion", F.col("suspicion"), t["assoc_high"],
             "trace how and when the value is written"),
        Rule("leak_proxy", "HIGH", F.col("is_proxy") & ~risk.isin("CRITICAL", "HIGH"), "mi", m, 0.75,
             "check the upstream source for label information"),
    ]
    found = apply_rules(leakage_rank(df, y, names, bins, t), "LEAKAGE", rules, F.col("feature"))
    if baseline is not None:
        rate = F.col("overlap_rate")
        overlap_rules = [
            Rule("overlap_critical", "CRITICAL", rate >= t["overlap_critical"], "overlap_rate", rate, t["overlap_critical"],
                 "remove training rows from the evaluation table"),
            Rule("overlap_elevated", "WARNING", (rate >= t["overlap_warning"]) & (rate < t["overlap_critical"]),
                 "overlap_rate", rate, t["overlap_warning"], "check how the tables were split"),
        ]
        found = found.unionByName(apply_rules(sample_overlap(df, baseline), "LEAKAGE", overlap_rules))
    return found


def leakage_health(findings: DataFrame) -> DataFrame:
    """The gate looks at critical features only: contamination alone lowers the score."""
    fatal = F.count_if(F.col("code").isin("target_missing", "target_constant")).alias("_fatal")
    scored = health(findings, PENALTIES)
    gate = findings.agg(
        F.count_if((F.col("severity") == "CRITICAL") & (F.col("code") != "overlap_critical")).alias("_crit"), fatal
    )
    return scored.join(F.broadcast(gate)).select(
        "n_findings",
        "n_critical",
        F.when(F.col("_fatal") > 0, F.lit(0.0)).otherwise(F.col("health_score")).alias("health_score"),
        ((F.col("_crit") == 0) & (F.col("health_score") >= 70)).alias("passed"),
    )
