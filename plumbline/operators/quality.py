"""Data-quality profile, semantic types and quality findings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import FLOATS, clamp, col, count_if, finite, is_numeric, missing, numeric_columns, ratio
from ..functions.cumulative import melt, quantiles
from ..functions.findings import Rule, apply_rules, health

# Tokens that make a two-valued column boolean.
BOOLEAN_TOKENS = ["0", "1", "0.0", "1.0", "true", "false", "True", "False", "T", "F", "Y", "N"]
# Text forms that count as missing at ingest.
NULL_TOKENS = ["", "nan", "null", "none", "na", "n/a"]
# Column names for roles. Role candidates and target suggestions use slightly different lists.
TARGET_ROLE_NAMES = ["target", "label", "y", "class", "outcome", "response", "fraud", "default"]
TARGET_NAMES = ["target", "label", "y", "is_fraud", "fraud", "default", "churn", "outcome", "response", "class"]
PREDICTION_NAMES = ["pred_prob", "prediction_probability", "probability", "score", "y_pred", "y_prob", "pred"]
PREDICTION_ROLE_PARTS = "pred|prob|score|^y_hat$"
PREDICTION_PARTS = "pred|prob"
PROTECTED_PARTS = "gender|sex|race|ethnicity|age|foreign|zip|nationality|disability"

THRESHOLDS = {
    "missing_warning": 0.02,
    "missing_critical": 0.20,
    "outlier_warning": 0.05,
    "outlier_critical": 0.15,
    "duplicate_warning": 0.01,
    "duplicate_critical": 0.05,
    "near_constant": 0.98,
}
PENALTIES = {"CRITICAL": 25, "HIGH": 8, "WARNING": 8, "MEDIUM": 4, "LOW": 1}
CHUNK = 50


def _chunks(names: Sequence[str]) -> list[list[str]]:
    return [list(names[i : i + CHUNK]) for i in range(0, len(names), CHUNK)]


def dataset_overview(df: DataFrame) -> DataFrame:
    """Rows, columns, cells, missing cells and the global missing rate in one scan."""
    width = len(df.columns)
    gaps = reduce(lambda a, b: a + b, [missing(df, c).cast("long") for c in df.columns], F.lit(0).cast("long"))
    out = df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(gaps), F.lit(0)).alias("missing_cells"))
    cells = F.col("n_rows") * width
    return out.select(
        "n_rows",
        F.lit(width).cast("long").alias("n_columns"),
        cells.alias("n_cells"),
        "missing_cells",
        ratio(F.col("missing_cells"), cells, 0).alias("missing_rate"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row; grouping treats NaN as equal to NaN and NULL to NULL."""
    groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    ).withColumn("duplicate_rate", ratio(F.col("duplicate_rows"), F.col("n_rows"), 0))


def missingness(df: DataFrame) -> DataFrame:
    """feature, n_rows, missing_count, missing_rate."""
    parts = []
    for names in _chunks(df.columns):
        wide = df.agg(
            F.count(F.lit(1)).alias("_rows"),
            *[F.count_if(missing(df, c)).alias(f"_m{i}") for i, c in enumerate(names)],
        )
        cells = [F.struct(F.lit(c).alias("feature"), F.col(f"_m{i}").alias("missing_count")) for i, c in enumerate(names)]
        parts.append(wide.select(F.col("_rows").alias("n_rows"), F.inline(F.array(*cells))))
    tall = reduce(DataFrame.unionByName, parts)
    return tall.select(
        "feature", "n_rows", "missing_count", ratio(F.col("missing_count"), F.col("n_rows"), 0).alias("missing_rate")
    )


def missingness_summary(df: DataFrame) -> DataFrame:
    return missingness(df).agg(
        F.count_if(F.col("missing_count") > 0).alias("columns_with_missing"),
        F.max("missing_rate").alias("max_missing_rate"),
    )


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Infinite count and min, max, mean, sample deviation over finite values."""
    names = list(columns) if columns is not None else numeric_columns(df)
    parts = []
    for chunk in _chunks(names):
        aggs = [F.count(F.lit(1)).alias("_rows")]
        for i, c in enumerate(chunk):
            x = finite(col(c))
            infinite = F.abs(col(c).cast("double")) == F.lit(float("inf"))
            aggs += [
                count_if(infinite).alias(f"_i{i}"),
                F.count(x).alias(f"_n{i}"),
                F.min(x).alias(f"_lo{i}"),
                F.max(x).alias(f"_hi{i}"),
                F.avg(x).alias(f"_mu{i}"),
                F.stddev_samp(x).alias(f"_sd{i}"),
            ]
        cells = [
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"_i{i}").alias("infinite_count"),
                F.col(f"_n{i}").alias("finite_count"),
                F.col(f"_lo{i}").alias("min"),
                F.col(f"_hi{i}").alias("max"),
                F.col(f"_mu{i}").alias("mean"),
                F.col(f"_sd{i}").alias("std"),
            )
            for i, c in enumerate(chunk)
        ]
        parts.append(df.agg(*aggs).select(F.col("_rows").alias("n_rows"), F.inline(F.array(*cells))))
    tall = reduce(DataFrame.unionByName, parts)
    return tall.select(
        "feature",
        "infinite_count",
        ratio(F.col("infinite_count"), F.col("n_rows"), 0).alias("infinite_rate"),
        "finite_count",
        "min",
        "max",
        "mean",
        "std",
    )


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """feature, value (text), n for all non-missing cells; partial counts are combined before the shuffle."""
    names = list(columns) if columns is not None else df.columns
    cells = {c: F.when(~missing(df, c), col(c).cast("string")) for c in names}
    return melt(df, cells).filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct non-missing values; ``approximate`` trades exactness for a constant-size state."""
    names = list(columns) if columns is not None else df.columns
    if approximate:
        cells = {c: F.when(~missing(df, c), col(c).cast("string")) for c in names}
        return melt(df, cells).groupBy("feature").agg(F.approx_count_distinct("value").alias("distinct_count"))
    return value_counts(df, names).groupBy("feature").agg(F.count(F.lit(1)).alias("distinct_count"))


def dominant_values(df: DataFrame, near_constant: float = THRESHOLDS["near_constant"]) -> DataFrame:
    """Most frequent value (ties: smallest text) and constancy flags per column."""
    top = (
        value_counts(df)
        .groupBy("feature")
        .agg(
            F.count(F.lit(1)).alias("distinct_count"),
            F.sum("n").alias("_n"),
            F.min(F.struct((-F.col("n")).alias("n"), F.col("value"))).alias("_top"),
        )
    )
    rate = ratio(-F.col("_top.n"), F.col("_n"))
    return top.select(
        "feature",
        "distinct_count",
        F.col("_top.value").alias("dominant_value"),
        rate.alias("dominant_rate"),
        (F.col("distinct_count") <= 1).alias("is_constant"),
        ((F.col("distinct_count") > 1) & (rate >= near_constant)).alias("is_near_constant"),
    )


def semantic_types(df: DataFrame) -> DataFrame:
    """NUMERIC, CATEGORICAL, BOOLEAN, DATETIME, TEXT or UNKNOWN for every column."""
    stats = _text_stats(df)
    names = F.array(*[F.lit(c) for c in df.columns])
    every = df.sparkSession.range(1).select(F.explode(names).alias("feature"))
    return every.join(F.broadcast(stats), "feature", "left").select("feature", _semantic(df).alias("semantic_type"))


def _text_stats(df: DataFrame) -> DataFrame:
    v, n = F.col("value"), F.col("n")
    looks_dated = (F.length(v) >= 8) & v.rlike("[-/T:]") & v.try_cast("timestamp").isNotNull()
    return (
        value_counts(df)
        .groupBy("feature")
        .agg(
            F.count(F.lit(1)).alias("distinct_count"),
            F.sum("n").alias("present_count"),
            F.min(F.struct((-n).alias("n"), v)).alias("_top"),
            F.count_if(v.isin(BOOLEAN_TOKENS)).alias("_tokens"),
            F.sum(F.length(v) * n).alias("_chars"),
            F.sum(F.when(looks_dated, n).otherwise(F.lit(0))).alias("_dated"),
        )
    )


def _semantic(df: DataFrame):
    kinds = {
        T.BooleanType: "BOOLEAN",
        T.DateType: "DATETIME",
        T.TimestampType: "DATETIME",
        T.TimestampNTZType: "DATETIME",
    }
    fixed = F.lit(None).cast("string")
    for f in df.schema:
        for kind, name in kinds.items():
            if isinstance(f.dataType, kind):
                fixed = F.when(F.col("feature") == f.name, F.lit(name)).otherwise(fixed)
    numbers = F.col("feature").isin([f.name for f in df.schema if isinstance(f.dataType, T.NumericType)])
    present = F.coalesce(F.col("present_count"), F.lit(0))
    return (
        F.when(present == 0, F.lit("UNKNOWN"))
        .when((F.col("distinct_count") == 2) & (F.col("_tokens") == 2), F.lit("BOOLEAN"))
        .when(fixed.isNotNull(), fixed)
        .when(~numbers & (F.col("_dated") >= present * 0.85), F.lit("DATETIME"))
        .when(numbers, F.lit("NUMERIC"))
        .when((F.col("_chars") > present * 60) & (F.col("distinct_count") > present * 0.4), F.lit("TEXT"))
        .otherwise(F.lit("CATEGORICAL"))
    )


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None, slices: int = 256) -> DataFrame:
    """Tukey fences from exact quartiles; a second scan counts the values outside."""
    names = list(columns) if columns is not None else numeric_columns(df)
    cells = {c: finite(col(c)) for c in names}
    q = quantiles(df, cells, {"q1": 0.25, "q3": 0.75}, slices)
    iqr = F.col("q3") - F.col("q1")
    wide = iqr > 0
    usable = F.col("n") >= 4
    fences = q.select(
        "feature",
        "n",
        F.when(usable, F.when(wide, F.col("q1") - iqr * 1.5).otherwise(F.col("q1"))).alias("lower_bound"),
        F.when(usable, F.when(wide, F.col("q3") + iqr * 1.5).otherwise(F.col("q3"))).alias("upper_bound"),
        (usable & wide).alias("_count"),
    )
    outside = (F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))
    hits = (
        melt(df, cells)
        .filter(F.col("value").isNotNull())
        .join(F.broadcast(fences), "feature")
        .groupBy("feature")
        .agg(F.count_if(F.col("_count") & outside).alias("outlier_count"))
    )
    return fences.join(F.broadcast(hits), "feature").select(
        "feature",
        F.col("n").alias("finite_count"),
        "lower_bound",
        "upper_bound",
        "outlier_count",
        ratio(F.col("outlier_count"), F.col("n"), 0).alias("outlier_rate"),
    )


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: missingness, cardinality, constancy, type, range and outliers."""
    numbers = numeric_columns(df)
    top = _text_stats(df)
    rate = ratio(-F.col("_top.n"), F.col("present_count"))
    base = missingness(df).join(F.broadcast(top), "feature", "left").select(
        "feature",
        _semantic(df).alias("semantic_type"),
        "n_rows",
        "missing_count",
        "missing_rate",
        F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"),
        F.col("_top.value").alias("dominant_value"),
        F.coalesce(rate, F.lit(0.0)).alias("dominant_rate"),
        (F.coalesce("distinct_count", F.lit(0)) <= 1).alias("is_constant"),
        F.coalesce((F.col("distinct_count") > 1) & (rate >= THRESHOLDS["near_constant"]), F.lit(False)).alias(
            "is_near_constant"
        ),
    )
    if not numbers:
        empty = {"infinite_count": "long", "infinite_rate": "double", "min": "double", "max": "double"}
        empty |= {"mean": "double", "std": "double", "lower_bound": "double", "upper_bound": "double"}
        empty |= {"outlier_count": "long", "outlier_rate": "double"}
        return base.withColumns({n: F.lit(None).cast(t) for n, t in empty.items()})
    summary = numeric_summary(df, numbers).drop("finite_count")
    fences = iqr_outliers(df, numbers).drop("finite_count")
    return base.join(F.broadcast(summary), "feature", "left").join(F.broadcast(fences), "feature", "left")


def quality_findings(df: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    t = {**THRESHOLDS, **(thresholds or {})}
    miss, out = F.col("missing_rate"), F.col("outlier_rate")
    column_rules = [
        Rule("missing_critical", "CRITICAL", miss >= t["missing_critical"], "missing_rate", miss,
             t["missing_critical"], "find the cause of the gaps or drop the column"),
        Rule("missing_elevated", "WARNING", (miss >= t["missing_warning"]) & (miss < t["missing_critical"]),
             "missing_rate", miss, t["missing_warning"], "choose an explicit imputation"),
        Rule("constant", "WARNING", F.col("is_constant"), "distinct_count", F.col("distinct_count"), 1.0,
             "drop the column, it carries no information"),
        Rule("near_constant", "INFO", F.col("is_near_constant"), "dominant_rate", F.col("dominant_rate"),
             t["near_constant"], "check that the rare values matter"),
        Rule("infinite_values", "CRITICAL", F.col("infinite_count") > 0, "infinite_count", F.col("infinite_count"),
             0.0, "clip or replace the infinite values"),
        Rule("outliers_severe", "HIGH", out >= t["outlier_critical"], "outlier_rate", out, t["outlier_critical"],
             "winsorize or scale robustly"),
        Rule("outliers_moderate", "MEDIUM", (out >= t["outlier_warning"]) & (out < t["outlier_critical"]),
             "outlier_rate", out, t["outlier_warning"], "inspect the tails"),
    ]
    dup = F.col("duplicate_rate")
    table_rules = [
        Rule("empty_table", "CRITICAL", F.col("n_rows") == 0, "n_rows", F.col("n_rows"), 1.0, "supply rows"),
        Rule("duplicates_critical", "CRITICAL", dup >= t["duplicate_critical"], "duplicate_rate", dup,
             t["duplicate_critical"], "look for replayed loads or fan-out joins"),
        Rule("duplicates_elevated", "WARNING", (dup >= t["duplicate_warning"]) & (dup < t["duplicate_critical"]),
             "duplicate_rate", dup, t["duplicate_warning"], "confirm that repeated rows are expected"),
    ]
    by_column = apply_rules(column_profile(df).filter(F.col("n_rows") > 0), "DATA_QUALITY", column_rules, F.col("feature"))
    return apply_rules(duplicate_rows(df), "DATA_QUALITY", table_rules).unionByName(by_column)


def quality_health(findings: DataFrame) -> DataFrame:
    """An empty table scores 0."""
    penalties = dict(PENALTIES)
    cost = F.when(F.col("code") == "empty_table", F.lit("EMPTY")).otherwise(F.col("severity"))
    scored = health(findings.withColumn("severity", cost), {**penalties, "EMPTY": 100})
    return scored.withColumn("passed", F.col("passed") & (F.col("health_score") > 0))


def ingest_profile(df: DataFrame, examples: int = 5, slices: int = 256) -> DataFrame:
    """Profile of a raw text table: null tokens, inferred type, nearest-rank quartiles, identifier flags."""
    text = {c: F.trim(col(c).cast("string")) for c in df.columns}
    cells = {c: F.when(~F.lower(v).isin(NULL_TOKENS), v) for c, v in text.items()}
    counts = (
        melt(df, cells).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    v, n = F.col("value"), F.col("n")
    present = F.when(v.isNotNull(), n).otherwise(F.lit(0))
    number = finite(v)
    per = counts.groupBy("feature").agg(
        F.sum("n").alias("n_rows"),
        F.sum(present).alias("present_count"),
        F.count(v).alias("distinct_count"),
        F.coalesce(F.sum(F.when(number.isNotNull(), n)), F.lit(0)).alias("_numeric"),
        F.coalesce(F.sum(F.when(v.rlike(r"^-?\d+$"), n)), F.lit(0)).alias("_integers"),
        F.count_if(F.lower(v).isin("true", "false", "0", "1", "yes", "no", "y", "n", "t", "f")).alias("_tokens"),
        F.max(present).alias("_top"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
        F.try_divide(F.sum(number * n), F.sum(F.when(number.isNotNull(), n))).alias("mean"),
    )
    # The rank filter becomes a partial top-k before the shuffle, so no feature is gathered whole.
    first = Window.partitionBy("feature").orderBy("value")
    shown = (
        counts.filter(v.isNotNull())
        .withColumn("_r", F.row_number().over(first))
        .filter(F.col("_r") <= examples)
        .groupBy("feature")
        .agg(F.array_sort(F.collect_list("value")).alias("examples"))
    )
    ranked = _nearest_rank(counts.filter(number.isNotNull()).select("feature", number.alias("value"), "n"), slices)
    kind = (
        F.when(F.col("present_count") == 0, F.lit("unknown"))
        .when((F.col("distinct_count") <= 2) & (F.col("_tokens") == F.col("distinct_count")), F.lit("boolean"))
        .when(F.col("_numeric") == F.col("present_count"), F.lit("numeric"))
        .when(F.col("distinct_count") < 30, F.lit("categorical"))
        .otherwise(F.lit("text"))
    )
    dtype = (
        F.when(kind == "boolean", F.lit("bool"))
        .when((kind == "numeric") & (F.col("_integers") == F.col("present_count")), F.lit("int64"))
        .when(kind == "numeric", F.lit("float64"))
        .otherwise(F.lit("object"))
    )
    distinct_rate = ratio(F.col("distinct_count"), F.col("present_count"), 0)
    top_rate = ratio(F.col("_top"), F.col("present_count"), 0)
    return (
        per.join(F.broadcast(ranked), "feature", "left")
        .join(F.broadcast(shown), "feature", "left")
        .select(
            "feature",
            kind.alias("inferred_type"),
            dtype.alias("dtype"),
            "n_rows",
            (F.col("n_rows") - F.col("present_count")).alias("null_count"),
            ratio(F.col("n_rows") - F.col("present_count"), F.col("n_rows"), 0).alias("null_rate"),
            "distinct_count",
            F.when(kind == "numeric", F.col("min")).alias("min"),
            F.when(kind == "numeric", F.col("max")).alias("max"),
            F.when(kind == "numeric", F.col("mean")).alias("mean"),
            F.when(kind == "numeric", F.col("p25")).alias("p25"),
            F.when(kind == "numeric", F.col("p50")).alias("p50"),
            F.when(kind == "numeric", F.col("p75")).alias("p75"),
            (F.col("distinct_count") <= 1).alias("is_constant"),
            ((F.col("distinct_count") > 1) & (F.col("present_count") >= 10) & (top_rate >= 0.99)).alias(
                "is_near_constant"
            ),
            ((F.lower("feature").rlike("(^|_)(id|uuid|key|hash)$")) | ((distinct_rate >= 0.95) & (F.col("distinct_count") > 50)))
            .alias("identifier_like"),
            ((F.col("distinct_count") > 50) | (distinct_rate > 0.5)).alias("high_cardinality"),
            "examples",
        )
    )


def _nearest_rank(counts: DataFrame, slices: int) -> DataFrame:
    from ..functions.cumulative import running_totals

    merged = counts.groupBy("feature", "value").agg(F.sum("n").alias("n"))
    cum = running_totals(merged, ["feature"], "value", ["n"], slices)
    aggs = []
    for name, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
        rank = F.ceil(F.lit(q) * F.col("tot_n"))
        aggs.append(F.max(F.when((F.col("lt_n") < rank) & (rank <= F.col("lt_n") + F.col("n")), F.col("value"))).alias(name))
    return cum.groupBy("feature").agg(*aggs)


def role_candidates(profile: DataFrame) -> DataFrame:
    """Columns that could serve as target (by name, or with two values), prediction or protected attribute (by name)."""
    name = F.lower("feature")
    roles = F.array(
        F.when(name.isin(TARGET_ROLE_NAMES) | name.startswith("is_") | (F.col("distinct_count") == 2), F.lit("target")),
        F.when(name.rlike(PREDICTION_ROLE_PARTS), F.lit("prediction")),
        F.when(name.rlike(PROTECTED_PARTS), F.lit("protected")),
    )
    return profile.select("feature", F.explode(F.filter(roles, lambda r: r.isNotNull())).alias("role"), "distinct_count")


def suggest_targets(profile: DataFrame, model_features: Sequence[str] = (), last_column: str | None = None) -> DataFrame:
    """Scored target suggestions; kept from 0.30 on."""
    name, d = F.lower("feature"), F.col("distinct_count")
    score = (
        F.when(name.isin(TARGET_NAMES), 0.45).when(name.rlike("^(is_|has_)"), 0.35).otherwise(0.0)
        + F.when(d == 2, 0.35).when((d >= 3) & (d <= 5) & (F.col("inferred_type") == "categorical"), 0.15).otherwise(0.0)
        + (F.when(~F.col("feature").isin(list(model_features)), 0.15).otherwise(0.0) if model_features else F.lit(0.0))
        + F.when(F.col("feature") == F.lit(last_column), 0.05).otherwise(0.0)
    )
    return profile.select("feature", F.round(score, 4).alias("score")).filter("score >= 0.30").orderBy(F.desc("score"), "feature")


def suggest_predictions(profile: DataFrame) -> DataFrame:
    """Scored prediction-column suggestions; kept from 0.30 on."""
    name = F.lower("feature")
    bounded = (F.col("inferred_type") == "numeric") & (F.col("min") >= 0) & (F.col("max") <= 1)
    score = F.when(name.isin(PREDICTION_NAMES), 0.60).when(name.rlike(PREDICTION_PARTS), 0.40).otherwise(
        0.0
    ) + F.when(F.coalesce(bounded, F.lit(False)), 0.30).otherwise(0.0)
    return profile.select("feature", F.round(score, 4).alias("score")).filter("score >= 0.30").orderBy(F.desc("score"), "feature")


def validate_inputs(
    evaluation: DataFrame,
    baseline: DataFrame | None = None,
    model_features: Sequence[str] = (),
    target: str | None = None,
    prediction: str | None = None,
    protected: str | None = None,
) -> DataFrame:
    """Coded compatibility problems between tables, model and chosen columns."""
    spark = evaluation.sparkSession
    have = set(evaluation.columns)
    rows: list[tuple[str, str, str]] = []
    for role, name, code in (
        ("target", target, "TARGET_NOT_FOUND"),
        ("prediction", prediction, "PREDICTION_NOT_FOUND"),
        ("protected", protected, "PROTECTED_NOT_FOUND"),
    ):
        if name and name not in have:
            rows.append(("ERROR", code, name))
    rows += [("ERROR", "MISSING_MODEL_FEATURE", f) for f in model_features if f not in have]
    if model_features:
        known = {*model_features, target, prediction, protected}
        rows += [("WARNING", "EXTRA_COLUMN", c) for c in evaluation.columns if c not in known]
    if target and target in set(model_features):
        rows.append(("ERROR", "TARGET_IS_FEATURE", target))
    if target and target == protected:
        rows.append(("ERROR", "PROTECTED_IS_TARGET", target))
    if target and target == prediction:
        rows.append(("ERROR", "PREDICTION_IS_TARGET", target))
    if baseline is not None:
        base = {f.name: f.dataType for f in baseline.schema}
        rows += [("WARNING", "BASELINE_COLUMN_MISSING", c) for c in evaluation.columns if c not in base]
        rows += [("WARNING", "BASELINE_COLUMN_EXTRA", c) for c in base if c not in have]
        for f in evaluation.schema:
            if f.name in base and isinstance(f.dataType, T.NumericType) != isinstance(base[f.name], T.NumericType):
                rows.append(("ERROR", "DTYPE_MISMATCH", f.name))
    if prediction in have and not is_numeric(evaluation, prediction):
        rows.append(("ERROR", "PREDICTION_NOT_NUMERIC", prediction))
    problems = spark.createDataFrame(rows, "level string, code string, subject string")
    checked = [c for c in (target, protected) if c in have]
    if not checked:
        return problems
    per = distinct_counts(evaluation, checked)
    d = F.col("distinct_count")
    cells = [
        F.when((F.col("feature") == F.lit(target)) & (d > 2), F.struct(F.lit("WARNING").alias("level"), F.lit("TARGET_NOT_BINARY").alias("code"))),
        F.when((F.col("feature") == F.lit(target)) & (d < 2), F.struct(F.lit("ERROR").alias("level"), F.lit("TARGET_SINGLE_CLASS").alias("code"))),
        F.when((F.col("feature") == F.lit(protected)) & (d < 2), F.struct(F.lit("ERROR").alias("level"), F.lit("PROTECTED_SINGLE_GROUP").alias("code"))),
        F.when((F.col("feature") == F.lit(protected)) & (d > 50), F.struct(F.lit("WARNING").alias("level"), F.lit("PROTECTED_CARDINALITY").alias("code"))),
    ]
    found = per.select("feature", F.inline(F.filter(F.array(*cells), lambda c: c.isNotNull())))
    return problems.unionByName(found.select("level", "code", F.col("feature").alias("subject")))
