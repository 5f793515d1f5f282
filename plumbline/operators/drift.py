"""Distribution drift between a baseline and an evaluation table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, finite, missing, ratio
from ..functions.cumulative import cumulative_counts, exact_quantiles, melt
from ..functions.findings import Rule, apply_rules, health
from ..functions.tails import chi2_p, kolmogorov
from ..session import cut_lineage
from .association import fdr, text_cells
from .quality import BOOLEAN_TOKENS

THRESHOLDS = {
    "psi_warning": 0.10,
    "psi_high": 0.25,
    "psi_severe": 0.40,
    "ks_warning": 0.10,
    "ks_high": 0.20,
    "both_critical": 0.35,
    "alpha": 0.05,
}
PENALTIES = {"CRITICAL": 20, "HIGH": 8, "WARNING": 8, "MEDIUM": 4, "LOW": 1}
EPSILON = 1e-4


def drift_types(df: DataFrame) -> DataFrame:
    """feature, drift_type: NUMERIC, CATEGORICAL (text, boolean or two-token) or UNKNOWN (nothing present).

    One aggregate over the rows: a numeric column has two boolean tokens if it
    holds nothing else and its least and greatest value differ. No value is shuffled.
    """
    aggs, cells = [], []
    for i, f in enumerate(df.schema):
        present, c = ~missing(df, f.name), col(f.name)
        aggs.append(F.count_if(present).alias(f"_p{i}"))
        kind = F.lit("CATEGORICAL")
        if isinstance(f.dataType, T.NumericType):
            held = F.when(present, c)
            aggs += [F.count_if(present & ~c.cast("string").isin(BOOLEAN_TOKENS)).alias(f"_o{i}"), (F.min(held) < F.max(held)).alias(f"_d{i}")]
            kind = F.when((F.col(f"_o{i}") == 0) & F.col(f"_d{i}"), kind).otherwise(F.lit("NUMERIC"))
        kind = F.when(F.col(f"_p{i}") == 0, F.lit("UNKNOWN")).otherwise(kind)
        cells.append(F.struct(F.lit(f.name).alias("feature"), kind.alias("drift_type")))
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def schema_drift(base: DataFrame, ev: DataFrame) -> DataFrame:
    """feature, status (COMMON, MISSING, NEW, TYPE_MISMATCH), both types and the severity."""
    b = drift_types(base).withColumnRenamed("drift_type", "base_type")
    e = drift_types(ev).withColumnRenamed("drift_type", "eval_type")
    status = (
        F.when(F.col("eval_type").isNull(), F.lit("MISSING"))
        .when(F.col("base_type").isNull(), F.lit("NEW"))
        .when(F.col("base_type") != F.col("eval_type"), F.lit("TYPE_MISMATCH"))
        .otherwise(F.lit("COMMON"))
    )
    severity = (
        F.when(F.col("status") == "MISSING", F.lit("CRITICAL"))
        .when(F.col("status") == "TYPE_MISMATCH", F.lit("HIGH"))
        .when(F.col("status") == "NEW", F.lit("INFO"))
    )
    return b.join(e, "feature", "full_outer").withColumn("status", status).withColumn("severity", severity)


def testable_columns(base: DataFrame, ev: DataFrame) -> tuple[list[str], list[str]]:
    """Common columns of equal type, split into numeric and categorical (names only reach the driver)."""
    rows = schema_drift(base, ev).filter(F.col("status") == "COMMON").select("feature", "base_type").collect()
    kinds = {r["feature"]: r["base_type"] for r in rows}
    numeric = [c for c in base.columns if kinds.get(c) == "NUMERIC"]
    categorical = [c for c in base.columns if kinds.get(c) in ("CATEGORICAL", "UNKNOWN")]
    return numeric, categorical


def two_sample_counts(base: DataFrame, ev: DataFrame, cols: Sequence[str], slices: int = 256) -> DataFrame:
    """Value-level table shared by KS, Wasserstein and PSI: counts of both sides with running totals."""
    cells = {c: finite(col(c)) for c in cols}
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    both = melt(base, cells, [one.alias("b"), zero.alias("e")]).unionByName(
        melt(ev, cells, [zero.alias("b"), one.alias("e")])
    )
    return cumulative_counts(
        both.filter(F.col("value").isNotNull()), ["feature"], "value", {"n_base": F.col("b"), "n_eval": F.col("e")}, slices
    )


def _ks(table: DataFrame) -> DataFrame:
    f = (F.col("lt_n_base") + F.col("n_base")) / F.col("tot_n_base")
    g = (F.col("lt_n_eval") + F.col("n_eval")) / F.col("tot_n_eval")
    out = table.filter((F.col("tot_n_base") > 0) & (F.col("tot_n_eval") > 0)).groupBy("feature").agg(
        F.max("tot_n_base").alias("n_base"), F.max("tot_n_eval").alias("n_eval"), F.max(F.abs(f - g)).alias("ks")
    )
    return out.withColumn("ks_p", kolmogorov(F.col("ks"), F.col("n_base"), F.col("n_eval")))


def ks_2samp(base: DataFrame, ev: DataFrame, cols: Sequence[str], slices: int = 256) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and asymptotic p-value per column."""
    return _ks(two_sample_counts(base, ev, cols, slices))


def _wasserstein(table: DataFrame) -> DataFrame:
    """W1 = sum |F - G| dx. Written per value without looking at its neighbour: on the
    span where F - G keeps the value taken at x, each x closes one span and opens another,
    so the sum is sum_x x * (|D before x| - |D after x|)."""
    before = F.abs(F.col("lt_n_base") / F.col("tot_n_base") - F.col("lt_n_eval") / F.col("tot_n_eval"))
    after = F.abs(
        (F.col("lt_n_base") + F.col("n_base")) / F.col("tot_n_base")
        - (F.col("lt_n_eval") + F.col("n_eval")) / F.col("tot_n_eval")
    )
    return table.filter((F.col("tot_n_base") > 0) & (F.col("tot_n_eval") > 0)).groupBy("feature").agg(
        F.sum(F.col("value") * (before - after)).alias("wasserstein"),
        (F.sum(F.col("value") * F.col("n_base")) / F.max("tot_n_base")).alias("_mean"),
        (F.sum(F.col("value") * F.col("value") * F.col("n_base")) / F.max("tot_n_base")).alias("_square"),
    )


def wasserstein(base: DataFrame, ev: DataFrame, cols: Sequence[str], slices: int = 256) -> DataFrame:
    """Wasserstein-1 distance, also scaled by the baseline IQR (else its population deviation)."""
    return _wasserstein_of(two_sample_counts(base, ev, cols, slices))


def _wasserstein_of(table: DataFrame) -> DataFrame:
    q = exact_quantiles(table, ["feature"], "value", "n_base", {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    std = F.sqrt(F.greatest(F.col("_square") - F.col("_mean") * F.col("_mean"), F.lit(0.0)))
    return _wasserstein(table).join(F.broadcast(q), "feature", "left").select(
        "feature",
        "wasserstein",
        F.when(iqr > 0, F.col("wasserstein") / iqr).when(std > 0, F.col("wasserstein") / std).alias("wasserstein_scaled"),
        F.when(iqr > 0, F.lit("IQR")).when(std > 0, F.lit("STD")).otherwise(F.lit("NONE")).alias("scaled_by"),
    )


def psi_edges(table: DataFrame, bins: int) -> DataFrame:
    """feature, edges: unique baseline quantiles from minimum to maximum."""
    probs = {f"e{i}": i / bins for i in range(bins + 1)}
    q = exact_quantiles(table, ["feature"], "value", "n_base", probs)
    return q.select("feature", F.array_distinct(F.array_sort(F.array(*probs))).alias("edges"))


def _psi_bins(table: DataFrame, bins: int, eps: float) -> DataFrame:
    inner = F.slice(F.col("edges"), 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    binned = table.join(F.broadcast(psi_edges(table, bins)), "feature").withColumn(
        "bin", F.size(F.filter(inner, lambda e: e <= F.col("value")))
    )
    counts = binned.groupBy("feature", "bin").agg(
        F.sum("n_base").alias("n_base"), F.sum("n_eval").alias("n_eval"), F.first("edges").alias("edges")
    )
    # Bins that hold no row of either side still enter the smoothing.
    shape = psi_edges(table, bins).select(
        "feature",
        F.size("edges").alias("n_edges"),
        F.explode(F.sequence(F.lit(0), F.greatest(F.size("edges") - 2, F.lit(0)))).alias("bin"),
    )
    full = shape.join(F.broadcast(counts.drop("edges")), ["feature", "bin"], "left").fillna(0, ["n_base", "n_eval"])
    w = Window.partitionBy("feature")
    k = F.count(F.lit(1)).over(w)
    expected = (F.col("n_base") + eps) / (F.sum("n_base").over(w) + eps * k)
    actual = (F.col("n_eval") + eps) / (F.sum("n_eval").over(w) + eps * k)
    return full.select(
        "feature",
        "bin",
        "n_edges",
        "n_base",
        "n_eval",
        ((actual - expected) * F.log(actual / expected)).alias("psi_part"),
    )


def _numeric_psi(table: DataFrame, bins: int, eps: float) -> DataFrame:
    binned = _psi_bins(table, bins, eps).groupBy("feature").agg(
        F.max("n_edges").alias("n_edges"), F.count(F.lit(1)).alias("n_bins"), F.sum("psi_part").alias("_psi")
    )
    # A constant baseline has one edge: compare the share of evaluation rows that differ from it.
    only = table.groupBy("feature").agg(
        F.max(F.when(F.col("n_base") > 0, F.col("value"))).alias("_v"), F.max("tot_n_eval").alias("_ne")
    )
    same = table.join(F.broadcast(only), "feature").groupBy("feature").agg(
        F.max("_ne").alias("_ne"), F.sum(F.when(F.col("value") == F.col("_v"), F.col("n_eval")).otherwise(0)).alias("_same")
    )
    differ = F.coalesce(F.lit(1.0) - F.try_divide(F.col("_same").cast("double"), F.col("_ne").cast("double")), F.lit(0.0))
    return binned.join(F.broadcast(same), "feature").select(
        "feature",
        "n_bins",
        F.when(F.col("n_edges") < 2, F.least(F.lit(10.0), differ * 5)).otherwise(F.col("_psi")).alias("psi"),
    )


def numeric_psi_bins(base: DataFrame, ev: DataFrame, cols: Sequence[str], bins: int = 10, eps: float = EPSILON) -> DataFrame:
    return _psi_bins(two_sample_counts(base, ev, cols), bins, eps).drop("n_edges")


def numeric_psi(
    base: DataFrame, ev: DataFrame, cols: Sequence[str], bins: int = 10, eps: float = EPSILON, slices: int = 256
) -> DataFrame:
    """Population stability index over unique baseline quantile bins."""
    return _numeric_psi(two_sample_counts(base, ev, cols, slices), bins, eps)


def category_counts(base: DataFrame, ev: DataFrame, cols: Sequence[str]) -> DataFrame:
    """feature, value, n_base, n_eval over the union of categories."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    both = melt(base, text_cells(base, cols), [one.alias("b"), zero.alias("e")]).unionByName(
        melt(ev, text_cells(ev, cols), [zero.alias("b"), one.alias("e")])
    )
    return both.filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.sum("b").alias("n_base"), F.sum("e").alias("n_eval")
    )


def _with_totals(counts: DataFrame) -> DataFrame:
    whole = counts.groupBy("feature").agg(
        F.sum("n_base").alias("t_base"), F.sum("n_eval").alias("t_eval"), F.count(F.lit(1)).alias("k")
    )
    return counts.join(F.broadcast(whole), "feature")


def categorical_psi(base: DataFrame, ev: DataFrame, cols: Sequence[str], eps: float = EPSILON) -> DataFrame:
    return _categorical_psi(category_counts(base, ev, cols), eps)


def _categorical_psi(counts: DataFrame, eps: float = EPSILON) -> DataFrame:
    t = _with_totals(counts)
    expected = (F.col("n_base") + eps) / (F.col("t_base") + F.col("k") * eps)
    actual = (F.col("n_eval") + eps) / (F.col("t_eval") + F.col("k") * eps)
    return t.groupBy("feature").agg(
        F.max("t_base").alias("n_base"),
        F.max("t_eval").alias("n_eval"),
        F.max("k").alias("n_categories"),
        F.when((F.max("t_base") > 0) & (F.max("t_eval") > 0), F.sum((actual - expected) * F.log(actual / expected)))
        .otherwise(F.lit(0.0))
        .alias("psi"),
    )


def chi2_drift(base: DataFrame, ev: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Chi-square of the 2 x k table (continuity corrected at one degree of freedom) with its p-value."""
    return _chi2(category_counts(base, ev, cols))


def _chi2(counts: DataFrame) -> DataFrame:
    t = _with_totals(counts)
    n = (F.col("t_base") + F.col("t_eval")).cast("double")
    cell = (F.col("n_base") + F.col("n_eval")) / n
    part = F.lit(0.0)
    for side in ("base", "eval"):
        expected = cell * F.col(f"t_{side}")
        gap = F.abs(F.col(f"n_{side}") - expected)
        gap = F.when(F.col("k") == 2, gap - F.least(gap, F.lit(0.5))).otherwise(gap)
        part = part + F.coalesce(F.try_divide(gap * gap, expected), F.lit(0.0))
    usable = (F.max("t_base") > 0) & (F.max("t_eval") > 0) & (F.max("k") >= 2)
    return (
        t.groupBy("feature")
        .agg(
            F.when(usable, F.sum(part)).otherwise(F.lit(0.0)).alias("chi2"),
            F.when(usable, F.max("k") - 1).otherwise(F.lit(0)).alias("dof"),
        )
        .withColumn("chi2_p", chi2_p(F.col("chi2"), F.col("dof").cast("double")))
    )


def drift_severity(psi: Column, ks: Column, significant: Column, tested: Column, t: dict) -> tuple[Column, Column]:
    """Practical magnitude and severity ladder; untested features stay LOW."""
    ks = F.coalesce(ks, F.lit(0.0))
    practical = (
        F.when(~tested, F.lit("LOW"))
        .when((psi >= t["psi_high"]) | (ks >= t["ks_high"]), F.lit("HIGH"))
        .when((psi >= t["psi_warning"]) | (ks >= t["ks_warning"]), F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )
    large = (ks >= t["both_critical"]) | (psi >= t["both_critical"])
    severity = (
        F.when(~tested, F.lit("LOW"))
        .when((psi >= t["psi_severe"]) | ((practical == "HIGH") & significant & large), F.lit("CRITICAL"))
        .when((practical == "HIGH") | ((practical == "MEDIUM") & significant), F.lit("HIGH"))
        .when((practical == "MEDIUM") | significant, F.lit("WARNING"))
        .otherwise(F.lit("LOW"))
    )
    return practical, severity


def drift_features(
    base: DataFrame,
    ev: DataFrame,
    numeric: Sequence[str] | None = None,
    categorical: Sequence[str] | None = None,
    bins: int = 10,
    thresholds: dict | None = None,
    slices: int = 256,
) -> DataFrame:
    """One row per common feature: KS, Wasserstein, PSI, chi-square, adjusted p and severity."""
    t = {**THRESHOLDS, **(thresholds or {})}
    if numeric is None or categorical is None:
        numeric, categorical = testable_columns(base, ev)
    null = F.lit(None).cast("double")
    parts = []
    if numeric:
        # Read by every statistic below, so the value-level table is stored once.
        table = cut_lineage(two_sample_counts(base, ev, numeric, slices))
        num = (
            _ks(table)
            .join(F.broadcast(_wasserstein_of(table)), "feature")
            .join(F.broadcast(_numeric_psi(table, bins, EPSILON)), "feature")
        )
        parts.append(
            num.select("feature", F.lit("NUMERIC").alias("kind"), "n_base", "n_eval", "ks", "wasserstein", "wasserstein_scaled",
                       null.alias("chi2"), "psi", F.col("ks_p").alias("p"))
        )
    if categorical:
        counts = cut_lineage(category_counts(base, ev, categorical))
        cat = _categorical_psi(counts).join(F.broadcast(_chi2(counts)), "feature")
        parts.append(
            cat.select("feature", F.lit("CATEGORICAL").alias("kind"), "n_base", "n_eval", null.alias("ks"), null.alias("wasserstein"),
                       null.alias("wasserstein_scaled"), "chi2", "psi", F.col("chi2_p").alias("p"))
        )
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    tested = (F.col("n_base") >= 2) & (F.col("n_eval") >= 2)
    adjusted = fdr(both.withColumn("p", F.when(tested, F.col("p"))), "p", ["kind"], "feature")
    significant = F.coalesce(F.col("p_adjusted") < t["alpha"], F.lit(False))
    practical, severity = drift_severity(F.col("psi"), F.col("ks"), F.col("significant"), tested, t)
    return (
        adjusted.withColumn("significant", significant)
        .withColumn("status", F.when(tested, F.lit("EVALUATED")).otherwise(F.lit("UNTESTABLE")))
        .withColumn("practical", practical)
        .withColumn("severity", severity)
        .orderBy(F.desc("psi"), "feature")
    )


def drift_findings(features: DataFrame, schema: DataFrame, thresholds: dict | None = None) -> DataFrame:
    t = {**THRESHOLDS, **(thresholds or {})}
    s, status = F.col("severity"), F.col("status")
    rules = [
        Rule("untestable", "WARNING", status == "UNTESTABLE", "n_eval", F.col("n_eval"), 2.0, "look at missing or infinite values"),
        Rule("drift_critical", "CRITICAL", s == "CRITICAL", "psi", F.col("psi"), t["psi_severe"], "retrain or recalibrate on recent data"),
        Rule("drift_high", "HIGH", s == "HIGH", "psi", F.col("psi"), t["psi_high"], "reweight, adapt or move the threshold"),
        Rule("drift_significant", "WARNING", (s == "WARNING") & F.col("significant"), "psi", F.col("psi"), t["psi_warning"],
             "keep watching the feature"),
    ]
    # One finding per kind of schema change, as a single problem may cover many columns.
    changes = schema.filter(status != "COMMON").groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    schema_rules = [
        Rule("schema_missing", "CRITICAL", status == "MISSING", "columns", F.col("n"), 0.0, "deliver every baseline column"),
        Rule("schema_type", "HIGH", status == "TYPE_MISMATCH", "columns", F.col("n"), 0.0, "align the encodings"),
        Rule("schema_new", "INFO", status == "NEW", "columns", F.col("n"), 0.0, "confirm that the columns are meant"),
    ]
    return apply_rules(features, "DRIFT", rules, F.col("feature")).unionByName(apply_rules(changes, "DRIFT", schema_rules))


def drift_report(features: DataFrame, schema: DataFrame) -> DataFrame:
    """Summary row: largest PSI, mean Wasserstein, tier counts, health."""
    s = F.col("severity")
    out = features.agg(
        F.count(F.lit(1)).alias("n_features"),
        F.max("psi").alias("max_psi"),
        F.min_by("feature", F.struct(-F.col("psi"), F.col("feature"))).alias("max_psi_feature"),
        F.avg(F.when(F.col("kind") == "NUMERIC", F.coalesce("wasserstein", F.lit(0.0)))).alias("mean_wasserstein"),
        F.count_if("significant").alias("n_significant"),
        F.count_if(F.col("practical") == "HIGH").alias("n_practical"),
        F.count_if(s == "CRITICAL").alias("n_drift_critical"),
        F.count_if(s == "HIGH").alias("n_drift_high"),
        F.count_if(s == "WARNING").alias("n_drift_medium"),
        F.count_if(s == "LOW").alias("n_drift_low"),
        F.count_if(F.col("status") == "UNTESTABLE").alias("n_untestable"),
    )
    return out.join(F.broadcast(health(drift_findings(features, schema), PENALTIES)))
