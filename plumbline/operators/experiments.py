"""Counterfactual table transforms, paired tests and acceptance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp, col, digest_uniform, finite, is_numeric, missing, ratio, uniform
from ..functions.cumulative import quantiles
from ..functions.tails import normal_p
from .isotonic import isotonic_apply, isotonic_blocks
from .performance import calibration_curve, calibration_summary, confusion, losses, threshold_grid
from .predicates import valid_pairs
from .quality import value_counts


def _quantile(df: DataFrame, name: str, **probs: float) -> dict[str, float | None]:
    """Exact quantiles of one column: a handful of numbers for the plan of the next step."""
    rows = quantiles(df, {name: finite(col(name))}, probs).collect()
    return {k: (rows[0][k] if rows else None) for k in probs}


def _mode(df: DataFrame, name: str) -> str | None:
    top = value_counts(df, [name]).agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("v"))
    return top.first()["v"]


def ablate(df: DataFrame, name: str, strategy: str = "zero") -> DataFrame:
    """Remove a feature's information: drop it, zero it, or set it to its median (text: mode)."""
    if name not in df.columns:
        raise ValueError(f"no column {name!r}")
    if strategy == "drop":
        return df.drop(name)
    if strategy == "median":
        value = F.lit(_quantile(df, name, m=0.5)["m"]) if is_numeric(df, name) else F.lit(_mode(df, name) or "")
    else:
        value = F.lit(0.0) if is_numeric(df, name) else F.lit("MISSING")
    return df.withColumn(name, value)


def clip_bounds(df: DataFrame, name: str, lo: float = 0.01, hi: float = 0.99) -> tuple[float | None, float | None]:
    if not is_numeric(df, name):
        raise ValueError(f"column {name!r} is not numeric")
    q = _quantile(df, name, lo=lo, hi=hi)
    return q["lo"], q["hi"]


def clip(df: DataFrame, name: str, lo: float = 0.01, hi: float = 0.99, flag: str | None = None) -> DataFrame:
    """Winsorize at exact quantiles; ``flag`` names an extra column that marks moved values."""
    low, high = clip_bounds(df, name, lo, hi)
    c = col(name).cast("double")
    moved = F.coalesce((c < low) | (c > high), F.lit(False))
    out = df if flag is None else df.withColumn(flag, moved)
    return out.withColumn(name, F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c))


def fill_missing(df: DataFrame, name: str, how: str = "median") -> DataFrame:
    if is_numeric(df, name):
        if how == "mean":
            value = df.agg(F.avg(finite(col(name))).alias("v")).first()["v"]
        elif how == "zero":
            value = 0.0
        else:
            value = _quantile(df, name, m=0.5)["m"]
        return df.withColumn(name, F.when(missing(df, name), F.lit(value if value is not None else 0.0)).otherwise(col(name).cast("double")))
    value = _mode(df, name)
    return df.withColumn(name, F.coalesce(col(name), F.lit("UNKNOWN" if value is None else value)))


def standardize(df: DataFrame, name: str) -> DataFrame:
    """(x - mean) / sample deviation; a zero deviation counts as 1."""
    if not is_numeric(df, name):
        raise ValueError(f"column {name!r} is not numeric")
    one = df.agg(F.avg(finite(col(name))).alias("m"), F.stddev_samp(finite(col(name))).alias("s")).first()
    return df.withColumn(name, (col(name).cast("double") - F.lit(one["m"])) / F.lit(one["s"] or 1.0))


def inject_missing(df: DataFrame, name: str, rate: float, seed: int, key: Sequence[str]) -> DataFrame:
    """Blank cells by a digest of the row key, so a rerun blanks the same rows; at least one when rate > 0."""
    draw = digest_uniform(seed, F.lit(name), *[col(k) for k in key])
    hit = draw < rate
    if rate > 0:
        lowest = df.agg(F.min(draw).alias("d")).first()["d"]
        if lowest is not None and lowest >= rate:
            hit = draw <= F.lit(lowest)
    return df.withColumn(name, F.when(~hit, col(name)))


def paired_comparison(df: DataFrame, y: str, b: str, c: str) -> DataFrame:
    """Flips, agreement cells and McNemar's test (continuity corrected) of two 0/1 predictions."""
    bb, cc = col(b) == 1, col(c) == 1
    out = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(col(y) == 1).alias("positives"),
        F.count_if(bb != cc).alias("changed"),
        F.count_if(~bb & ~cc).alias("n00"),
        F.count_if(~bb & cc).alias("n01"),
        F.count_if(bb & ~cc).alias("n10"),
        F.count_if(bb & cc).alias("n11"),
    )
    gap = F.greatest(F.abs(F.col("n01") - F.col("n10")) - 1, F.lit(0)).cast("double")
    stat = F.coalesce(F.try_divide(gap * gap, (F.col("n01") + F.col("n10")).cast("double")), F.lit(0.0))
    # One degree of freedom: the chi-square tail is the two-sided normal tail of its root.
    return out.withColumn("flip_rate", ratio(F.col("changed"), F.col("n"), 0)).withColumn("mcnemar", stat).withColumn(
        "mcnemar_p", normal_p(F.sqrt("mcnemar"))
    )


def shift_summary(df: DataFrame, pb: str, pc: str) -> DataFrame:
    d = col(pc) - col(pb)
    base = df.agg(F.count(d).alias("n"), F.avg(d).alias("mean_shift"), F.avg(F.abs(d)).alias("mean_abs_shift"))
    q = quantiles(df, {"shift": d}, {"median_shift": 0.5}).select("median_shift")
    return base.join(F.broadcast(q), how="left")


# Cumulative probabilities of a Poisson(1) count, for inverse sampling.
_POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
            0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402, 0.9999998885745217]


def shift_ci(df: DataFrame, pb: str, pc: str, key: Sequence[str], n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """Seeded Poisson bootstrap interval of the mean shift, by rows at every size.

    Every row draws its own weight in every replicate; weighted sums are combined
    on the map side, so ``n_boot`` rows a task are shuffled and the work is rows x replicates.
    """
    if n_boot < 1:
        raise ValueError("n_boot must be at least 1")
    d = (col(pc) - col(pb)).alias("_d")
    rows = df.select(d, F.xxhash64(*[col(k) for k in key], F.lit(seed)).alias("_h")).filter("_d is not null")
    u = uniform(F.col("_h"), F.col("rep"), seed)
    w = F.lit(0)
    for edge in _POISSON:
        w = w + F.when(u >= edge, 1).otherwise(0)
    reps = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n_boot)))).withColumn("w", w)
    means = reps.groupBy("rep").agg(F.try_divide(F.sum(F.col("_d") * F.col("w")), F.sum("w").cast("double")).alias("m"))
    ci = means.agg(F.percentile("m", F.lit(0.025)).alias("ci_low"), F.percentile("m", F.lit(0.975)).alias("ci_high"), F.count("m").alias("replicates"))
    return shift_summary(df, pb, pc).join(F.broadcast(ci))


def threshold_counterfactual(df: DataFrame, y: str, p: str, t0: float, t1: float) -> DataFrame:
    """metric, baseline, candidate, delta when the threshold moves from t0 to t1."""
    names = ["accuracy", "precision", "recall", "f1", "fpr", "fnr"]
    a, b = confusion(df, y, p, t0), confusion(df, y, p, t1)
    pair = a.select(*[F.col(n).alias(f"a_{n}") for n in names]).join(F.broadcast(b.select(*[F.col(n).alias(f"b_{n}") for n in names])))
    cells = F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(f"a_{n}").alias("baseline"), F.col(f"b_{n}").alias("candidate"),
                 (F.col(f"b_{n}") - F.col(f"a_{n}")).alias("delta")) for n in names
    ])
    return pair.select(F.inline(cells))


def threshold_curve(df: DataFrame, y: str, p: str) -> DataFrame:
    return threshold_grid(df, y, p, 21)


def calibrate(ev: DataFrame, calib: DataFrame, y: str, p: str, method: str = "PLATT", out: str = "p_calibrated") -> DataFrame:
    """Refit the probabilities on an independent table of at least 20 rows.

    ``ISOTONIC`` is the exact step function over all distinct scores, with straight
    lines between its blocks; ``PLATT`` a logistic curve over the log odds.
    """
    calib = valid_pairs(calib, y, p)
    n = calib.count()
    if n < 20:
        raise ValueError("calibration needs at least 20 rows of an independent table")
    q = clamp(col(p), 1e-6, 1 - 1e-6)
    if method == "ISOTONIC":
        blocks = isotonic_blocks(calib.withColumn("_y", (col(y) == 1).cast("double")), "_y", p)
        return isotonic_apply(valid_pairs(ev, y, p), blocks, p, out)
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    logit = array_to_vector(F.array(F.log(q / (F.lit(1.0) - q))))
    # The usual unit penalty on the sum of losses equals 1/n on their mean.
    lr = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1.0 / n, standardization=False, maxIter=200, tol=1e-10)
    model = lr.fit(calib.select(logit.alias("_x"), col(y).cast("double").alias("_y")))
    w, b = float(model.coefficients[0]), float(model.intercept)
    z = F.log(q / (F.lit(1.0) - q)) * w + b
    return valid_pairs(ev, y, p).withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


def calibration_counterfactual(ev: DataFrame, calib: DataFrame, y: str, p: str, method: str = "PLATT") -> DataFrame:
    """ECE and Brier score before and after recalibration."""
    after = calibrate(ev, calib, y, p, method)

    def summary(score: str, tag: str) -> DataFrame:
        e = calibration_summary(calibration_curve(after, y, score)).select(F.col("ece").alias(f"{tag}_ece"))
        return e.join(F.broadcast(losses(after, y, score).select(F.col("brier").alias(f"{tag}_brier"))))

    both = summary(p, "baseline").join(F.broadcast(summary("p_calibrated", "candidate")))
    return both.select(
        F.lit(method).alias("method"), "baseline_ece", "candidate_ece", (F.col("candidate_ece") - F.col("baseline_ece")).alias("ece_delta"),
        "baseline_brier", "candidate_brier", (F.col("candidate_brier") - F.col("baseline_brier")).alias("brier_delta"),
    )


def subgroup_counterfactual(df: DataFrame, attr: str, y: str, b: str, c: str) -> DataFrame:
    """Accuracy, F1 and flips per group for two 0/1 predictions, with deltas."""
    pos = col(y) == 1
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(col(b) != col(c)).alias("flips")]
    for tag, name in (("b", b), ("c", c)):
        hit = col(name) == 1
        aggs += [F.count_if(hit == pos).alias(f"{tag}_right"), F.count_if(hit & pos).alias(f"{tag}_tp"),
                 F.count_if(hit & ~pos).alias(f"{tag}_fp"), F.count_if(~hit & pos).alias(f"{tag}_fn")]
    g = df.groupBy(col(attr).cast("string").alias("grp")).agg(*aggs)

    def f1(tag):
        two = F.col(f"{tag}_tp") * 2
        return ratio(two, two + F.col(f"{tag}_fp") + F.col(f"{tag}_fn"), 0)

    acc = {t: ratio(F.col(f"{t}_right"), F.col("n")) for t in "bc"}
    return g.select(
        "grp", "n", "flips", ratio(F.col("flips"), F.col("n")).alias("flip_rate"),
        acc["b"].alias("baseline_accuracy"), acc["c"].alias("candidate_accuracy"), (acc["c"] - acc["b"]).alias("accuracy_delta"),
        f1("b").alias("baseline_f1"), f1("c").alias("candidate_f1"), (f1("c") - f1("b")).alias("f1_delta"),
    )


# The standard criteria and guards (kind, metric, test, bound).
STANDARD_CRITERIA = [
    ("ACCEPT", "psi", "VALUE_LT", 0.10),
    ("ACCEPT", "f1", "DELTA_GE", -0.01),
    ("ACCEPT", "fnr", "DELTA_LT", 0.0),
    ("ACCEPT", "ece", "DELTA_LT", 0.0),
    ("GUARD", "fnr", "DELTA_LE", 0.01),
    ("GUARD", "f1", "DELTA_GE", -0.05),
    ("GUARD", "accuracy", "DELTA_GE", -0.02),
    ("GUARD", "confident_rate", "DELTA_LE", 0.05),
    ("GUARD", "disparate_impact", "VALUE_GE", 0.80),
]
CRITERIA_SCHEMA = "kind string, metric string, test string, bound double"


def criteria_table(spark, rows: Sequence[tuple] = STANDARD_CRITERIA) -> DataFrame:
    return spark.createDataFrame(list(rows), CRITERIA_SCHEMA)


def judge_criteria(deltas: DataFrame, criteria: DataFrame) -> DataFrame:
    """Each criterion with its values and verdict; a metric that was not measured has verdict NULL."""
    v, d, x = F.col("candidate"), F.col("delta"), F.col("bound")
    verdict = (
        F.when(F.col("test") == "VALUE_LT", v < x)
        .when(F.col("test") == "VALUE_GE", v >= x)
        .when(F.col("test") == "DELTA_LT", d < x)
        .when(F.col("test") == "DELTA_LE", d <= x)
        .when(F.col("test") == "DELTA_GE", d >= x)
    )
    return criteria.join(deltas.select("metric", "baseline", "candidate", "delta"), "metric", "left").withColumn("passed", verdict)


def evaluate_acceptance(deltas: DataFrame, criteria: DataFrame) -> DataFrame:
    """VALIDATED, PARTIALLY_VALIDATED, REJECTED or INCONCLUSIVE.

    A failed guard rejects. Anything unmeasured leaves the outcome open, unless it is
    already rejected.
    """
    j = judge_criteria(deltas, criteria)
    accept, guard = F.col("kind") == "ACCEPT", F.col("kind") == "GUARD"
    out = j.agg(
        F.count_if(accept).alias("criteria"),
        F.count_if(accept & F.col("passed")).alias("criteria_passed"),
        F.count_if(F.col("passed").isNull()).alias("unmeasured"),
        F.count_if(guard & ~F.col("passed")).alias("guards_failed"),
    )
    total, ok = F.col("criteria"), F.col("criteria_passed")
    return out.withColumn(
        "conclusion",
        F.when(F.col("guards_failed") > 0, F.lit("REJECTED"))
        .when((total == 0) | (F.col("unmeasured") > 0), F.lit("INCONCLUSIVE"))
        .when(ok == total, F.lit("VALIDATED"))
        .when(ok > 0, F.lit("PARTIALLY_VALIDATED"))
        .otherwise(F.lit("REJECTED")),
    )


# Metrics compared between two runs (module, metric, higher is better).
COMPARED = [
    ("PERFORMANCE", "roc_auc", True), ("PERFORMANCE", "pr_auc", True), ("PERFORMANCE", "f1", True),
    ("PERFORMANCE", "precision", True), ("PERFORMANCE", "recall", True), ("PERFORMANCE", "log_loss", False),
    ("PERFORMANCE", "brier_score", False), ("PERFORMANCE", "expected_calibration_error", False),
    ("PERFORMANCE", "false_positive_rate", False), ("PERFORMANCE", "false_negative_rate", False),
    ("ERROR_FORENSICS", "overall_error_rate", False), ("ERROR_FORENSICS", "false_positive_count", False),
    ("ERROR_FORENSICS", "false_negative_count", False), ("ERROR_FORENSICS", "high_confidence_error_rate", False),
    ("ERROR_FORENSICS", "high_confidence_error_count", False), ("DRIFT", "max_psi", False),
    ("LEAKAGE", "max_leakage_score", False), ("BIAS", "worst_disparate_impact_ratio", True),
    ("BIAS", "equal_opportunity_gap", False), ("BIAS", "demographic_parity_gap", False),
    ("ROBUSTNESS", "gaussian_jitter_5pct_flip_rate", False), ("ROBUSTNESS", "boundary_flip_rate", False),
]


def compare_runs(obs: DataFrame, run_a: str, run_b: str, compared: Sequence[tuple] = COMPARED, flat: float = 0.005) -> DataFrame:
    """Global metrics of two runs side by side: delta and direction, or which side lacks it."""
    catalog = obs.sparkSession.createDataFrame(list(compared), "module string, metric_name string, higher_is_better boolean")
    mine = obs.filter(F.col("run_id").isin(run_a, run_b) & (F.col("target_key") == "GLOBAL"))
    side = lambda r: F.max(F.when(F.col("run_id") == r, F.col("metric_value")))
    wide = mine.groupBy("metric_name").agg(side(run_a).alias("baseline"), side(run_b).alias("candidate"))
    delta = F.col("candidate") - F.col("baseline")
    better = F.when(F.col("higher_is_better"), delta > 0).otherwise(delta < 0)
    direction = (
        F.when(F.col("baseline").isNull(), F.lit("MISSING_IN_BASELINE"))
        .when(F.col("candidate").isNull(), F.lit("MISSING_IN_CANDIDATE"))
        .when(F.abs(delta) < flat, F.lit("NO_MATERIAL_CHANGE"))
        .when(better, F.lit("IMPROVED"))
        .otherwise(F.lit("REGRESSED"))
    )
    return wide.join(F.broadcast(catalog), "metric_name").select(
        "module", "metric_name", "baseline", "candidate", delta.alias("delta"), direction.alias("direction")
    )


def overall_assessment(comparison: DataFrame) -> DataFrame:
    d = F.col("direction")
    out = comparison.agg(
        F.count_if(d == "IMPROVED").alias("improved"),
        F.count_if(d == "REGRESSED").alias("regressed"),
        F.count_if(d == "NO_MATERIAL_CHANGE").alias("unchanged"),
        F.count_if(d.startswith("MISSING")).alias("missing"),
    )
    i, r = F.col("improved"), F.col("regressed")
    return out.withColumn(
        "assessment",
        F.when(i + r + F.col("unchanged") == 0, F.lit("INSUFFICIENT_EVIDENCE"))
        .when((r == 0) & (i > 0), F.lit("IMPROVED"))
        .when((i == 0) & (r > 0), F.lit("REGRESSED"))
        .when(i > 0, F.lit("MIXED"))
        .otherwise(F.lit("NO_MATERIAL_CHANGE")),
    )


