"""Binary classification performance and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp, col, ratio
from ..functions.cumulative import cumulative_counts, melt
from ..functions.findings import Rule, apply_rules, health
from .predicates import map_binary, valid_pair_counts, valid_pairs

THRESHOLDS = {
    "auc_critical": 0.60,
    "auc_warning": 0.70,
    "fnr_critical": 0.50,
    "fnr_warning": 0.30,
    "fpr_critical": 0.40,
    "f1_critical": 0.30,
    "f1_warning": 0.50,
    "ece_critical": 0.10,
    "ece_warning": 0.05,
    "invalid_critical": 0.05,
}
PENALTIES = {"CRITICAL": 25, "HIGH": 10, "WARNING": 10, "MEDIUM": 4, "LOW": 1}
LOG_EPS = 2.220446049250313e-16


def grid(steps: int) -> list[float]:
    """Evenly spaced points from 0 to 1, by repeated step so that edges keep their usual rounding."""
    step = 1.0 / (steps - 1)
    return [i * step for i in range(steps - 1)] + [1.0]


def bucket(p: Column, edges: list[float]) -> Column:
    """Number of edges at or below ``p``: exact comparisons, no rounding of p * bins."""
    out = F.lit(0)
    for e in edges:
        out = out + F.when(p >= F.lit(e), 1).otherwise(0)
    return out


def prediction_audit(df: DataFrame, y: str, p: str) -> DataFrame:
    out = valid_pair_counts(df, y, p)
    rate = F.col("invalid_rate")
    return out.withColumn(
        "severity",
        F.when(rate > THRESHOLDS["invalid_critical"], F.lit("CRITICAL")).when(rate > 0, F.lit("HIGH")),
    )


def confusion_rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Rates derived from the four cells, with the conventions for empty denominators."""
    n = tp + fp + tn + fn
    precision = F.when(tp + fp > 0, ratio(tp, tp + fp)).when(tp + fn > 0, F.lit(0.0)).otherwise(F.lit(1.0))
    recall = ratio(tp, tp + fn, 0)
    return {
        "accuracy": ratio(tp + tn, n, 0),
        "precision": precision,
        "recall": recall,
        "specificity": ratio(tn, tn + fp, 0),
        "f1": F.coalesce(F.try_divide(precision * recall * 2, precision + recall), F.lit(0.0)),
        "fpr": ratio(fp, fp + tn, 0),
        "fnr": ratio(fn, fn + tp, 0),
        "predicted_positive_rate": ratio(tp + fp, n, 0),
    }


def confusion(df: DataFrame, y: str, p: str, t: float = 0.5) -> DataFrame:
    """Confusion matrix and rates at one threshold (positive when p >= t)."""
    hit, pos = col(p) >= t, col(y) == 1
    cells = valid_pairs(df, y, p).agg(
        F.count_if(hit & pos).alias("tp"),
        F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & ~pos).alias("tn"),
        F.count_if(~hit & pos).alias("fn"),
    )
    rates = confusion_rates(*[F.col(c) for c in ("tp", "fp", "tn", "fn")])
    return cells.select(F.lit(float(t)).alias("threshold"), "tp", "fp", "tn", "fn", *[c.alias(n) for n, c in rates.items()])


def threshold_grid(df: DataFrame, y: str, p: str, steps: int = 21) -> DataFrame:
    """Confusion at every grid threshold from one histogram pass and a short suffix sum."""
    points = grid(steps)
    pairs = valid_pairs(df, y, p)
    hist = pairs.groupBy(bucket(col(p), points).alias("b")).agg(
        F.count_if(col(y) == 1).alias("pos"), F.count_if(col(y) != 1).alias("neg")
    )
    spine = df.sparkSession.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(i + 1).alias("b"), F.lit(round(v, 3)).alias("threshold")) for i, v in enumerate(points)]))
    )
    full = spine.join(F.broadcast(hist), "b", "full_outer").fillna(0, ["pos", "neg"])
    down = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    tp, fp = F.sum("pos").over(down), F.sum("neg").over(down)
    cells = full.select(
        "threshold",
        tp.alias("tp"),
        fp.alias("fp"),
        (F.sum("neg").over(whole) - fp).alias("tn"),
        (F.sum("pos").over(whole) - tp).alias("fn"),
    ).filter(F.col("threshold").isNotNull())
    rates = confusion_rates(*[F.col(c) for c in ("tp", "fp", "tn", "fn")])
    return cells.select("threshold", "tp", "fp", "tn", "fn", *[c.alias(n) for n, c in rates.items()])


def best_thresholds(table: DataFrame) -> DataFrame:
    """Lowest threshold with the best F1 and with the best balanced accuracy."""
    balanced = (F.col("recall") + F.col("specificity")) / 2

    def first_best(value: Column) -> Column:
        # Compared at four decimals, as reported, so that float noise does not break ties.
        return F.max_by("threshold", F.struct(F.round(value, 4), -F.col("threshold")))

    return table.agg(
        first_best(F.col("f1")).alias("best_f1_threshold"),
        F.max("f1").alias("best_f1"),
        first_best(balanced).alias("best_balanced_threshold"),
        F.max(balanced).alias("best_balanced_accuracy"),
    )


def score_table(df: DataFrame, y: str, p: str, slices: int = 256) -> DataFrame:
    """One row per distinct probability: pos, neg and their running totals."""
    tall = melt(valid_pairs(df, y, p), {"p": col(p)}, [col(y).alias("y")])
    return cumulative_counts(
        tall, ["feature"], "value",
        {"pos": (F.col("y") == 1).cast("long"), "neg": (F.col("y") != 1).cast("long")}, slices,
    )


def _auc() -> Column:
    wins = F.sum(F.col("pos") * (F.col("lt_neg") + F.col("neg") / 2))
    return F.try_divide(wins, F.max(F.col("tot_pos").cast("double") * F.col("tot_neg")))


def _average_precision() -> Column:
    above_pos = F.col("tot_pos") - F.col("lt_pos")
    above_neg = F.col("tot_neg") - F.col("lt_neg")
    return F.try_divide(F.sum(F.col("pos") * above_pos / (above_pos + above_neg)), F.max("tot_pos").cast("double"))


def _log_loss_term() -> Column:
    p = clamp(F.col("value"), LOG_EPS, 1.0 - LOG_EPS)
    return -(F.col("pos") * F.log(p) + F.col("neg") * F.log(F.lit(1.0) - p))


def roc_auc(df: DataFrame, y: str, p: str, slices: int = 256) -> DataFrame:
    """Tie-aware ROC-AUC by rank sums; NULL with one class."""
    return score_table(df, y, p, slices).agg(_auc().alias("roc_auc"))


def average_precision(df: DataFrame, y: str, p: str, slices: int = 256) -> DataFrame:
    return score_table(df, y, p, slices).agg(_average_precision().alias("average_precision"))


def losses(df: DataFrame, y: str, p: str) -> DataFrame:
    """Log loss and Brier score in one plain aggregate."""
    q = clamp(col(p), LOG_EPS, 1.0 - LOG_EPS)
    one = (col(y) == 1).cast("double")
    return valid_pairs(df, y, p).agg(
        F.avg(-(one * F.log(q) + (F.lit(1.0) - one) * F.log(F.lit(1.0) - q))).alias("log_loss"),
        F.avg((col(p) - one) * (col(p) - one)).alias("brier"),
    )


def log_loss(df: DataFrame, y: str, p: str) -> DataFrame:
    return losses(df, y, p).select("log_loss")


def brier(df: DataFrame, y: str, p: str) -> DataFrame:
    return losses(df, y, p).select("brier")


def calibration_curve(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Uniform reliability bins; empty bins are emitted with their midpoint."""
    edges = grid(bins + 1)
    b = F.least(bucket(col(p), edges), F.lit(bins)) - 1
    hist = valid_pairs(df, y, p).groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(col(p)).alias("_p"), F.avg((col(y) == 1).cast("double")).alias("_y")
    )
    spine = df.sparkSession.range(1).select(
        F.inline(F.array(*[
            F.struct(F.lit(i).alias("bin"), F.lit(edges[i]).alias("lower"), F.lit(edges[i + 1]).alias("upper"))
            for i in range(bins)
        ]))
    )
    gap = F.coalesce(F.col("_p") - F.col("_y"), F.lit(0.0))
    return spine.join(F.broadcast(hist), "bin", "left").select(
        "bin",
        F.round("lower", 2).alias("lower"),
        F.round("upper", 2).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce(F.col("_p"), (F.col("lower") + F.col("upper")) / 2).alias("mean_p"),
        F.coalesce("_y", F.lit(0.0)).alias("observed"),
        F.abs(gap).alias("abs_error"),
        gap.alias("delta"),
    )


def tendency(ece: Column, signed: Column) -> Column:
    return (
        F.when(ece < 0.05, F.lit("WELL_CALIBRATED"))
        .when(signed > 0.03, F.lit("OVERCONFIDENT"))
        .when(signed < -0.03, F.lit("UNDERCONFIDENT"))
        .otherwise(F.lit("MIXED"))
    )


def calibration_summary(curve: DataFrame) -> DataFrame:
    whole = F.sum("n")
    ece = F.try_divide(F.sum(F.col("n") * F.col("abs_error")), whole.cast("double"))
    signed = F.try_divide(F.sum(F.col("n") * F.col("delta")), whole.cast("double"))
    return curve.agg(ece.alias("ece"), F.max("abs_error").alias("mce"), signed.alias("signed_error")).withColumn(
        "tendency", tendency(F.col("ece"), F.col("signed_error"))
    )


def prevalence_baseline(df: DataFrame, y: str, p: str) -> DataFrame:
    """Losses of always predicting the base rate, and whether the model beats both."""
    q = clamp(col(p), LOG_EPS, 1.0 - LOG_EPS)
    one = (col(y) == 1).cast("double")
    out = valid_pairs(df, y, p).agg(
        F.avg(one).alias("positive_rate"),
        F.avg(-(one * F.log(q) + (F.lit(1.0) - one) * F.log(F.lit(1.0) - q))).alias("log_loss"),
        F.avg((col(p) - one) * (col(p) - one)).alias("brier"),
    )
    return _with_prevalence(out)


def _with_prevalence(out: DataFrame) -> DataFrame:
    r = clamp(F.col("positive_rate"), 1e-12, 1 - 1e-12)
    prior_loss = -(r * F.log(r) + (F.lit(1.0) - r) * F.log(F.lit(1.0) - r))
    prior_brier = F.col("positive_rate") * (F.lit(1.0) - F.col("positive_rate"))
    return (
        out.withColumn("prior_log_loss", prior_loss)
        .withColumn("prior_brier", prior_brier)
        .withColumn(
            "beats_prior", (F.col("log_loss") < F.col("prior_log_loss")) & (F.col("brier") < F.col("prior_brier"))
        )
    )


def performance_metrics(df: DataFrame, y: str, p: str, t: float = 0.5, bins: int = 10, slices: int = 256) -> DataFrame:
    """Every headline metric as one row, all read off the distinct-probability table."""
    table = score_table(df, y, p, slices)
    v, n = F.col("value"), F.col("pos") + F.col("neg")
    hit = v >= t
    edges = grid(bins + 1)
    b = F.least(bucket(v, edges), F.lit(bins)) - 1
    aggs = [
        F.max("tot_pos").alias("positives"),
        F.max("tot_neg").alias("negatives"),
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        _auc().alias("roc_auc"),
        _average_precision().alias("average_precision"),
        F.sum(_log_loss_term()).alias("_loss"),
        F.sum(F.col("pos") * (v - 1) * (v - 1) + F.col("neg") * v * v).alias("_square"),
    ]
    for i in range(bins):
        aggs.append(F.sum(F.when(b == i, n * v - F.col("pos")).otherwise(0)).alias(f"_gap{i}"))
        aggs.append(F.sum(F.when(b == i, n).otherwise(0)).alias(f"_n{i}"))
    one = table.agg(*aggs)
    size = (F.col("positives") + F.col("negatives")).cast("double")
    gaps = [F.col(f"_gap{i}") for i in range(bins)]
    ece = sum((F.abs(g) for g in gaps), F.lit(0.0)) / size
    mce = F.greatest(*[F.coalesce(F.try_divide(F.abs(F.col(f"_gap{i}")), F.col(f"_n{i}").cast("double")), F.lit(0.0)) for i in range(bins)])
    signed = sum(gaps, F.lit(0.0)) / size
    base = one.withColumn("tn", F.col("negatives") - F.col("fp")).withColumn("fn", F.col("positives") - F.col("tp"))
    rates = confusion_rates(*[F.col(c) for c in ("tp", "fp", "tn", "fn")])
    out = base.select(
        (F.col("positives") + F.col("negatives")).alias("n"),
        "positives",
        ratio(F.col("positives"), size).alias("positive_rate"),
        "tp", "fp", "tn", "fn",
        *[c.alias(name) for name, c in rates.items()],
        "roc_auc",
        "average_precision",
        F.try_divide(F.col("_loss"), size).alias("log_loss"),
        F.try_divide(F.col("_square"), size).alias("brier"),
        ece.alias("ece"),
        mce.alias("mce"),
        signed.alias("signed_error"),
    )
    return _with_prevalence(out).withColumn("tendency", tendency(F.col("ece"), F.col("signed_error")))


def performance_findings(metrics: DataFrame, audit: DataFrame, thresholds: dict | None = None) -> DataFrame:
    t = {**THRESHOLDS, **(thresholds or {})}
    auc, fnr, fpr, f1, ece = (F.col(c) for c in ("roc_auc", "fnr", "fpr", "f1", "ece"))
    usable = (F.col("positives") > 0) & (F.col("positives") < F.col("n")) & (F.col("n") >= 2)
    rules = [
        Rule("too_few_rows", "CRITICAL", F.col("n") < 2, "n", F.col("n"), 2.0, "supply at least two valid rows"),
        Rule("single_class", "CRITICAL", (F.col("n") >= 2) & ~usable, "positives", F.col("positives"), 1.0, "both classes are needed"),
        Rule("auc_critical", "CRITICAL", usable & (auc < t["auc_critical"]), "roc_auc", auc, t["auc_critical"], "rework features or model"),
        Rule("auc_low", "WARNING", usable & (auc >= t["auc_critical"]) & (auc < t["auc_warning"]), "roc_auc", auc, t["auc_warning"],
             "look for more informative features"),
        Rule("fnr_high", "HIGH", usable & (fnr >= t["fnr_critical"]), "fnr", fnr, t["fnr_critical"], "lower the threshold"),
        Rule("fnr_elevated", "WARNING", usable & (fnr >= t["fnr_warning"]) & (fnr < t["fnr_critical"]), "fnr", fnr, t["fnr_warning"],
             "consider a lower threshold"),
        Rule("fpr_high", "HIGH", usable & (fpr >= t["fpr_critical"]), "fpr", fpr, t["fpr_critical"], "raise the threshold"),
        Rule("f1_low", "HIGH", usable & (f1 < t["f1_critical"]), "f1", f1, t["f1_critical"], "tune the threshold, rebalance the classes"),
        Rule("ece_high", "HIGH", usable & (ece >= t["ece_critical"]), "ece", ece, t["ece_critical"], "recalibrate the probabilities"),
        Rule("ece_elevated", "WARNING", usable & (ece >= t["ece_warning"]) & (ece < t["ece_critical"]), "ece", ece, t["ece_warning"],
             "check the reliability curve"),
        Rule("below_prior", "HIGH", usable & ~F.col("beats_prior"), "brier", F.col("brier"), F.col("prior_brier"),
             "the base rate alone does better"),
    ]
    rate = F.col("invalid_rate")
    invalid = [Rule("invalid_predictions", F.col("severity"), rate > 0, "invalid_rate", rate, 0.0, "repair the scoring output")]
    return apply_rules(metrics, "PERFORMANCE", rules).unionByName(apply_rules(audit, "PERFORMANCE", invalid))


def performance_report(df: DataFrame, y: str, p: str, t: float = 0.5, positive: str | None = None) -> DataFrame:
    """Metrics row plus health. Labels are mapped to 0/1 first; more than two classes is an error."""
    mapped = map_binary(df, y, positive, "_y")
    metrics = performance_metrics(mapped, "_y", p, t)
    findings = performance_findings(metrics, prediction_audit(mapped, "_y", p))
    return metrics.join(F.broadcast(health(findings, PENALTIES)))
