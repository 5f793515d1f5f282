"""Where and why a classifier is wrong."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp, col, finite, ratio, wilson
from ..functions.cumulative import cumulative_counts, exact_quantiles, melt, quantiles
from ..functions.findings import Rule, apply_rules
from ..functions.tails import normal_p, student_p
from .association import cramers_v, fdr
from .performance import bucket, confusion_rates, grid
from .predicates import valid_pairs

THRESHOLDS = {
    "confident": 0.75,
    "confident_critical": 0.20,
    "confident_warning": 0.10,
    "disparity_critical": 1.50,
}


def evaluation_table(df: DataFrame, y: str, p: str, t: float = 0.5) -> DataFrame:
    """All input columns plus y, p, pred, is_error, error_type, confidence, p_error and margin."""
    pos, prob = (col(y) == 1).cast("int"), col(p)
    hit = (prob >= t).cast("int")
    kind = (
        F.when((pos == 1) & (hit == 1), F.lit("TP"))
        .when((pos == 0) & (hit == 0), F.lit("TN"))
        .when(hit == 1, F.lit("FP"))
        .otherwise(F.lit("FN"))
    )
    return valid_pairs(df, y, p).withColumns(
        {
            "_y": pos,
            "_p": prob,
            "_pred": hit,
            "is_error": (pos != hit).cast("int"),
            "error_type": kind,
            "confidence": F.when(hit == 1, prob).otherwise(F.lit(1.0) - prob),
            "p_error": F.abs(pos - prob),
            "margin": F.abs(prob - F.lit(float(t))),
        }
    )


def error_distribution(et: DataFrame) -> DataFrame:
    """Count, share and mean probability of each outcome; outcomes that do not occur are listed with 0."""
    per = et.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"), F.avg("_p").alias("mean_p"))
    spine = et.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k) for k in ("TP", "TN", "FP", "FN")])).alias("error_type"))
    whole = Window.partitionBy()
    n = F.coalesce("n", F.lit(0))
    return spine.join(F.broadcast(per), "error_type", "left").select(
        "error_type", n.alias("n"), ratio(n, F.sum(n).over(whole), 0).alias("share"), F.coalesce("mean_p", F.lit(0.0)).alias("mean_p")
    )


def error_summary(et: DataFrame) -> DataFrame:
    cells = et.agg(*[F.count_if(F.col("error_type") == k).alias(k.lower()) for k in ("TP", "FP", "TN", "FN")])
    rates = confusion_rates(*[F.col(c) for c in ("tp", "fp", "tn", "fn")])
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    errors = F.col("fp") + F.col("fn")
    return cells.select(
        n.alias("n"), errors.alias("errors"), ratio(errors, n, 0).alias("error_rate"), "tp", "fp", "tn", "fn",
        *[c.alias(k) for k, c in rates.items()],
    )


def confidence_errors(et: DataFrame, high: float = THRESHOLDS["confident"], slices: int = 256) -> DataFrame:
    """Confidence statistics of errors: mean, exact median and p90, bands, high-confidence counts."""
    c, bad = F.col("confidence"), F.col("is_error") == 1
    band = lambda lo, hi: F.count_if(bad & (c >= lo) & ((c < hi) if hi < 1 else (c <= hi)))
    stats = et.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(bad).alias("errors"),
        F.avg(F.when(bad, c)).alias("mean_confidence"),
        F.max(F.when(bad, c)).alias("max_confidence"),
        F.avg(F.when(~bad, c)).alias("mean_correct_confidence"),
        F.count_if(bad & (c >= high)).alias("confident_errors"),
        band(0.5, 0.6).alias("band_low"),
        band(0.6, 0.75).alias("band_moderate"),
        band(0.75, 0.9).alias("band_high"),
        band(0.9, 1.0).alias("band_very_high"),
    )
    q = quantiles(et.filter(bad), {"confidence": c}, {"median_confidence": 0.5, "p90_confidence": 0.9}, slices)
    tops = q.agg(F.max("median_confidence").alias("median_confidence"), F.max("p90_confidence").alias("p90_confidence"))
    return stats.join(F.broadcast(tops)).withColumns(
        {
            "confident_rate": ratio(F.col("confident_errors"), F.col("n"), 0),
            "confident_share": ratio(F.col("confident_errors"), F.col("errors"), 0),
        }
    )


def class_separation(et: DataFrame, cols: Sequence[str]) -> DataFrame:
    """comparison (FP_VS_TN, FN_VS_TP), feature, group means and Cohen's d with the pooled sample variance."""
    tall = melt(et, {c: finite(col(c)) for c in cols}, ["error_type"]).filter(F.col("value").isNotNull())
    aggs = []
    for k in ("TP", "FP", "TN", "FN"):
        x = F.when(F.col("error_type") == k, F.col("value"))
        aggs += [F.count(x).alias(f"n_{k}"), F.avg(x).alias(f"m_{k}"), F.var_samp(x).alias(f"v_{k}")]
    wide = tall.groupBy("feature").agg(*aggs)

    def side(name: str, a: str, b: str) -> Column:
        na, nb = F.col(f"n_{a}"), F.col(f"n_{b}")
        pooled = F.sqrt(F.try_divide((na - 1) * F.col(f"v_{a}") + (nb - 1) * F.col(f"v_{b}"), (na + nb - 2).cast("double")))
        d = F.when((na >= 2) & (nb >= 2), F.coalesce(F.try_divide(F.col(f"m_{a}") - F.col(f"m_{b}"), pooled), F.lit(0.0)))
        return F.struct(
            F.lit(name).alias("comparison"), na.alias("n_error"), nb.alias("n_correct"),
            F.col(f"m_{a}").alias("mean_error"), F.col(f"m_{b}").alias("mean_correct"), F.coalesce(d, F.lit(0.0)).alias("cohens_d"),
        )

    return wide.select("feature", F.inline(F.array(side("FP_VS_TN", "FP", "TN"), side("FN_VS_TP", "FN", "TP"))))


def mann_whitney(et: DataFrame, cols: Sequence[str], slices: int = 256) -> DataFrame:
    """Two-sided U test per feature and comparison: ranks from running totals, normal tail with tie correction."""
    tall = melt(et, {c: finite(col(c)) for c in cols}, ["error_type"]).filter(F.col("value").isNotNull())
    weights = {k: (F.col("error_type") == k).cast("long") for k in ("TP", "FP", "TN", "FN")}
    table = cumulative_counts(tall, ["feature"], "value", weights, slices)
    aggs = []
    for a, b in (("FP", "TN"), ("FN", "TP")):
        tie = (F.col(a) + F.col(b)).cast("double")
        aggs += [
            F.max(f"tot_{a}").alias(f"n_{a}"),
            F.max(f"tot_{b}").alias(f"n_{b}"),
            F.sum(F.col(a) * (F.col(f"lt_{b}") + F.col(b) / 2)).alias(f"u_{a}"),
            F.sum(tie * tie * tie - tie).alias(f"t_{a}"),
        ]
    wide = table.groupBy("feature").agg(*aggs)

    def side(name: str, a: str, b: str) -> Column:
        na, nb = F.col(f"n_{a}").cast("double"), F.col(f"n_{b}").cast("double")
        n, mean = na + nb, na * nb / 2
        var = na * nb / 12 * (n + 1 - F.try_divide(F.col(f"t_{a}"), n * (n - 1)))
        z = F.try_divide(F.abs(F.col(f"u_{a}") - mean) - 0.5, F.sqrt(var))
        return F.struct(
            F.lit(name).alias("comparison"), F.col(f"n_{a}").alias("n_error"), F.col(f"n_{b}").alias("n_correct"),
            F.col(f"u_{a}").alias("u"), F.greatest(z, F.lit(0.0)).alias("z"),
        )

    rows = wide.select("feature", F.inline(F.array(side("FP_VS_TN", "FP", "TN"), side("FN_VS_TP", "FN", "TP"))))
    return rows.filter((F.col("n_error") >= 2) & (F.col("n_correct") >= 2)).withColumn(
        "p", F.coalesce(normal_p(F.col("z")), F.lit(1.0))
    )


def feature_separation(et: DataFrame, cols: Sequence[str], slices: int = 256) -> DataFrame:
    """Cohen's d with the adjusted U-test p-value, strongest first."""
    d = class_separation(et, cols)
    u = mann_whitney(et, cols, slices).select("feature", "comparison", "p")
    both = d.join(F.broadcast(u), ["feature", "comparison"])
    return fdr(both, "p", ["comparison"], "feature").orderBy("comparison", F.desc(F.abs("cohens_d")), "feature")


def error_association(et: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Point-biserial r of each feature with the error flag, and its t-test p-value."""
    aggs, cells = [], []
    for i, c in enumerate(cols):
        x = finite(col(c))
        aggs += [F.count(x).alias(f"_n{i}"), F.corr(x, F.when(x.isNotNull(), F.col("is_error").cast("double"))).alias(f"_r{i}"),
                 F.stddev_pop(x).alias(f"_s{i}")]
        cells.append(F.struct(F.lit(c).alias("feature"), F.col(f"_n{i}").alias("n"), F.col(f"_r{i}").alias("r"), F.col(f"_s{i}").alias("s")))
    rows = et.agg(*aggs).select(F.inline(F.array(*cells))).filter((F.col("n") >= 5) & (F.col("s") > 1e-9))
    r = F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0))
    dof = (F.col("n") - 2).cast("double")
    t = F.try_divide(F.abs(r) * F.sqrt(dof), F.sqrt(F.lit(1.0) - r * r))
    return rows.select("feature", "n", r.alias("r"), F.coalesce(t, F.lit(float("inf"))).alias("t")).withColumn(
        "p", student_p(F.col("t"), (F.col("n") - 2).cast("double"))
    )


def error_association_cat(et: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cramer's V of categorical features with the error flag, the FP flag and the FN flag."""
    flags = {
        "ERROR": (et, F.col("is_error")),
        "FP_VS_TN": (et.filter(F.col("_y") == 0), F.col("_pred")),
        "FN_VS_TP": (et.filter(F.col("_y") == 1), F.lit(1) - F.col("_pred")),
    }
    out = None
    for name, (rows, flag) in flags.items():
        part = cramers_v(rows, cols, flag).select(F.lit(name).alias("comparison"), "feature", "n", "cramers_v")
        out = part if out is None else out.unionByName(part)
    return out


def error_ranges(et: DataFrame, cols: Sequence[str], bins: int = 5, slices: int = 256) -> DataFrame:
    """Error rate by quantile range of every feature; ranking features is the caller's choice.

    ``is_testable`` is false for features with fewer than 30 values, fewer than
    five different ones, or a single range; ``is_small`` marks ranges under 30 rows.
    """
    cells = {c: finite(col(c)) for c in cols}
    tall = melt(et, cells, ["is_error", "error_type", "_p", "confidence"]).filter(F.col("value").isNotNull())
    table = cumulative_counts(tall, ["feature"], "value", {"n_rows": F.lit(1)}, slices)
    probs = {f"e{i}": i / bins for i in range(bins + 1)}
    levels = table.groupBy("feature").agg(F.count(F.lit(1)).alias("levels"))
    edges = (
        exact_quantiles(table, ["feature"], "value", "n_rows", probs)
        .join(F.broadcast(levels), "feature")
        .withColumn("edges", F.array_distinct(F.array_sort(F.array(*probs))))
        .select(
            "feature", ((F.col("n") >= 30) & (F.col("levels") >= 5) & (F.size("edges") >= 3)).alias("is_testable"),
            # A constant feature has one range from its value to its value.
            F.when(F.size("edges") == 1, F.concat("edges", "edges")).otherwise(F.col("edges")).alias("edges"),
        )
    )
    last = F.size("edges") - 2
    b = F.least(F.size(F.filter("edges", lambda e: e <= F.col("value"))) - 1, last)
    binned = tall.join(F.broadcast(edges), "feature").groupBy("feature", b.alias("bin")).agg(
        F.first("edges").alias("edges"),
        F.first("is_testable").alias("is_testable"),
        F.count(F.lit(1)).alias("n"),
        F.sum("is_error").alias("errors"),
        F.count_if(F.col("error_type") == "FP").alias("fp"),
        F.count_if(F.col("error_type") == "FN").alias("fn"),
        F.avg("_p").alias("mean_p"),
        F.avg("confidence").alias("mean_confidence"),
    )
    overall = et.agg(F.avg(F.col("is_error").cast("double")).alias("_rate"))
    rate = ratio(F.col("errors"), F.col("n"))
    return binned.join(F.broadcast(overall)).select(
        "feature", "bin",
        F.get("edges", F.col("bin")).alias("lower"),
        F.get("edges", F.col("bin") + 1).alias("upper"),
        "n", "errors", rate.alias("error_rate"), "fp", "fn", "mean_p", "mean_confidence",
        ((F.col("_rate") > 0) & (rate >= F.col("_rate") * 1.35)).alias("is_enriched"),
        (F.col("n") < 30).alias("is_small"), "is_testable",
    )


def top_errors(et: DataFrame, key: Sequence[str], k: int = 50, extra: Sequence[str] = ()) -> DataFrame:
    """The k errors with the highest priority; a distributed top-k, ties by key."""
    priority = F.round(F.col("confidence") * 50 + F.col("margin") * 30 + F.col("p_error") * 20, 2)
    return (
        et.filter(F.col("is_error") == 1)
        .select(*map(col, key), "error_type", F.col("_p").alias("p"), "confidence", "p_error", priority.alias("priority"), *map(col, extra))
        .orderBy(F.desc("priority"), *map(col, key))
        .limit(k)
    )


def operating_points(et: DataFrame, steps: int = 21) -> DataFrame:
    """Confusion along the rounded threshold grid, from one histogram."""
    points = [round(v, 2) for v in grid(steps)]
    hist = et.groupBy(bucket(F.col("_p"), points).alias("b")).agg(
        F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg")
    )
    spine = et.sparkSession.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(i + 1).alias("b"), F.lit(v).alias("threshold")) for i, v in enumerate(points)]))
    )
    down = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    tp, fp = F.sum("pos").over(down), F.sum("neg").over(down)
    whole = Window.partitionBy()
    full = spine.join(F.broadcast(hist), "b", "full_outer").fillna(0, ["pos", "neg"]).select(
        "threshold", tp.alias("tp"), fp.alias("fp"),
        (F.sum("neg").over(whole) - fp).alias("tn"), (F.sum("pos").over(whole) - tp).alias("fn"),
    ).filter(F.col("threshold").isNotNull())
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision = F.coalesce(ratio(tp, tp + fp), F.when(F.col("threshold") >= 0.99, F.lit(1.0)).otherwise(F.lit(0.0)))
    recall = ratio(tp, tp + fn, 0)
    return full.select(
        "threshold", "tp", "fp", "tn", "fn", precision.alias("precision"), recall.alias("recall"),
        F.coalesce(F.try_divide(precision * recall * 2, precision + recall), F.lit(0.0)).alias("f1"),
        ratio(fp, fp + tn, 0).alias("fpr"), ratio(fn, fn + tp, 0).alias("fnr"),
    )


def calibration_errors(et: DataFrame, bins: int = 10) -> DataFrame:
    """Reliability bins that hold rows, with their error counts and a severe-gap flag."""
    edges = grid(bins + 1)
    b = F.least(bucket(F.col("_p"), edges), F.lit(bins)) - 1
    per = et.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_p").alias("mean_p"),
        F.avg(F.col("_y").cast("double")).alias("observed"),
        F.sum("is_error").alias("errors"),
    )
    gap = F.abs(F.col("mean_p") - F.col("observed"))
    return per.select(
        "bin", "n", "mean_p", "observed", gap.alias("gap"), "errors", ratio(F.col("errors"), F.col("n")).alias("error_rate"),
        ((gap >= 0.10) & (F.col("n") >= 10)).alias("is_severe"),
    )


def subgroup_errors(et: DataFrame, attr: str, minimum: int = 5, high: float = THRESHOLDS["confident"]) -> DataFrame:
    """Error counts and rates of every group; ``is_small`` marks groups under ``minimum`` rows."""
    per = et.filter(col(attr).isNotNull()).groupBy(col(attr).cast("string").alias("grp")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("is_error").alias("errors"),
        F.count_if(F.col("error_type") == "FP").alias("fp"),
        F.count_if(F.col("error_type") == "FN").alias("fn"),
        F.count_if((F.col("is_error") == 1) & (F.col("confidence") >= high)).alias("confident_errors"),
    )
    low, up = wilson(F.col("errors"), F.col("n"))
    return per.select(
        "grp", "n", "errors", ratio(F.col("errors"), F.col("n")).alias("error_rate"), "fp", "fn", "confident_errors",
        low.alias("rate_low"), up.alias("rate_high"), (F.col("n") < minimum).alias("is_small"),
    )


def subgroup_disparity(groups: DataFrame) -> DataFrame:
    """Largest over smallest error rate of the groups that are not small; a zero minimum counts as 0.01."""
    low = F.min("error_rate")
    return groups.filter(~F.col("is_small")).agg(
        F.max("error_rate").alias("max_rate"),
        low.alias("min_rate"),
        F.round(F.max("error_rate") / F.when(low > 0, low).otherwise(F.lit(0.01)), 2).alias("disparity"),
    )


def forensics_findings(
    et: DataFrame,
    numeric: Sequence[str] = (),
    categorical: Sequence[str] = (),
    attr: str | None = None,
    thresholds: dict | None = None,
) -> DataFrame:
    t = {**THRESHOLDS, **(thresholds or {})}
    hc = F.col("confident_rate")
    out = apply_rules(confidence_errors(et, t["confident"]), "ERROR_FORENSICS", [
        Rule("confident_critical", "CRITICAL", hc >= t["confident_critical"], "confident_rate", hc, t["confident_critical"],
             "recalibrate and inspect the confident errors"),
        Rule("confident_elevated", "WARNING", (hc >= t["confident_warning"]) & (hc < t["confident_critical"]), "confident_rate", hc,
             t["confident_warning"], "inspect the confident errors"),
    ])
    strengths = []
    if numeric:
        strengths.append(class_separation(et, numeric).select("comparison", "feature", F.abs("cohens_d").alias("s")))
    if categorical:
        v = error_association_cat(et, categorical)
        strengths.append(v.filter(F.col("comparison") != "ERROR").select("comparison", "feature", F.col("cramers_v").alias("s")))
    if strengths:
        every = strengths[0] if len(strengths) == 1 else strengths[0].unionByName(strengths[1])
        top = every.groupBy("comparison").agg(F.max("s").alias("s"), F.min_by("feature", F.struct(-F.col("s"), F.col("feature"))).alias("feature"))
        out = out.unionByName(apply_rules(top, "ERROR_FORENSICS", [
            Rule("fp_separation", "WARNING", (F.col("comparison") == "FP_VS_TN") & (F.col("s") >= 0.5), "separation", F.col("s"), 0.5,
                 "false alarms sit in their own region of this feature"),
            Rule("fn_separation", "WARNING", (F.col("comparison") == "FN_VS_TP") & (F.col("s") >= 0.5), "separation", F.col("s"), 0.5,
                 "misses sit in their own region of this feature")], F.col("feature")))
    if numeric:
        r = F.abs("r")
        strong = fdr(error_association(et, numeric), "p", [], "feature").filter((F.col("p_adjusted") < 0.05) & (r >= 0.15))
        top = strong.agg(F.max(r).alias("s"), F.min_by("feature", F.struct(-r, F.col("feature"))).alias("feature"))
        level = F.when(F.col("s") >= 0.30, F.lit("HIGH")).otherwise(F.lit("WARNING"))
        out = out.unionByName(apply_rules(top, "ERROR_FORENSICS", [
            Rule("error_association", level, F.col("s").isNotNull(), "association", F.col("s"), 0.15,
                 "errors follow this feature")], F.col("feature")))
    if attr:
        d = F.col("disparity")
        out = out.unionByName(apply_rules(subgroup_disparity(subgroup_errors(et, attr)), "ERROR_FORENSICS", [
            Rule("subgroup_disparity", "CRITICAL", d >= t["disparity_critical"], "disparity", d, t["disparity_critical"],
                 "compare data and thresholds of the groups")], F.lit(attr)))
    return out


# Points taken off per finding.
FINDING_PENALTY = {"confident_critical": 30, "confident_elevated": 15, "subgroup_disparity": 20}


def forensics_report(et: DataFrame, findings: DataFrame) -> DataFrame:
    """Health = 100 - 50 x error rate - penalties; passes from 60 on while errors stay below half."""
    points = F.lit(0.0)
    for code, v in FINDING_PENALTY.items():
        points = F.when(F.col("code") == code, F.lit(float(v))).otherwise(points)
    cost = findings.agg(F.coalesce(F.sum(points), F.lit(0.0)).alias("_cost"), F.count(F.lit(1)).alias("n_findings"))
    score = F.round(clamp(F.lit(100.0) - F.col("error_rate") * 50 - F.col("_cost"), 0, 100), 1)
    return error_summary(et).join(F.broadcast(cost)).withColumn("health_score", score).withColumn(
        "passed", (F.col("health_score") >= 60) & (F.col("error_rate") < 0.5)
    ).drop("_cost")
