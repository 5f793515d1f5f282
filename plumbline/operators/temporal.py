"""Run histories: observations, trends, change points, issue tracks, temporal alerts.

Histories may be long and one lineage may hold a large part of all rows, so no
operator sorts a whole series in one task. ``positions`` gives every point its
index, the series length and prefix sums; trends, baselines, change points and
streaks are then plain aggregates with conditions on the index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..functions.cumulative import cumulative_counts, exact_quantiles, running_totals
from ..functions.tails import normal_p, student_p

SERIES = ["lineage_id", "module", "metric_name", "target_type", "target_key"]
TARGET = ["lineage_id", "target_type", "target_key"]
SLICES = 64

# Metric, module, higher is better, warning, critical, unit.
METRICS = [
    ("f1", "PERFORMANCE", True, 0.70, 0.50, "score"),
    ("roc_auc", "PERFORMANCE", True, 0.75, 0.60, "auc"),
    ("pr_auc", "PERFORMANCE", True, 0.60, 0.40, "auc"),
    ("accuracy", "PERFORMANCE", True, 0.75, 0.60, "score"),
    ("precision", "PERFORMANCE", True, 0.70, 0.50, "score"),
    ("recall", "PERFORMANCE", True, 0.70, 0.50, "score"),
    ("log_loss", "PERFORMANCE", False, 0.50, 0.80, "loss"),
    ("brier_score", "PERFORMANCE", False, 0.15, 0.25, "score"),
    ("expected_calibration_error", "PERFORMANCE", False, 0.08, 0.15, "ece"),
    ("false_positive_rate", "PERFORMANCE", False, 0.15, 0.30, "rate"),
    ("false_negative_rate", "PERFORMANCE", False, 0.15, 0.30, "rate"),
    ("psi", "DRIFT", False, 0.10, 0.25, "psi"),
    ("max_psi", "DRIFT", False, 0.10, 0.25, "psi"),
    ("ks_statistic", "DRIFT", False, 0.15, 0.30, "stat"),
    ("wasserstein", "DRIFT", False, 0.20, 0.40, "dist"),
    ("drifted_feature_count", "DRIFT", False, 1.0, 3.0, "count"),
    ("high_confidence_error_rate", "ERROR_FORENSICS", False, 0.05, 0.15, "rate"),
    ("overall_error_rate", "ERROR_FORENSICS", False, 0.15, 0.30, "rate"),
    ("error_association", "ERROR_FORENSICS", False, 0.15, 0.25, "r"),
    ("subgroup_disparity_ratio", "ERROR_FORENSICS", False, 1.30, 1.60, "ratio"),
    ("disparate_impact", "BIAS", True, 0.80, 0.60, "ratio"),
    ("worst_disparate_impact_ratio", "BIAS", True, 0.80, 0.60, "ratio"),
    ("demographic_parity_gap", "BIAS", False, 0.10, 0.20, "gap"),
    ("equal_opportunity_gap", "BIAS", False, 0.10, 0.20, "gap"),
    ("flip_rate", "ROBUSTNESS", False, 0.10, 0.20, "rate"),
    ("gaussian_jitter_5pct_flip_rate", "ROBUSTNESS", False, 0.10, 0.20, "rate"),
    ("boundary_flip_rate", "ROBUSTNESS", False, 0.10, 0.20, "rate"),
    ("mean_probability_shift", "ROBUSTNESS", False, 0.05, 0.10, "shift"),
    ("top1_attribution_share", "EXPLAINABILITY", False, 0.50, 0.70, "share"),
    ("top3_attribution_share", "EXPLAINABILITY", False, 0.80, 0.95, "share"),
    ("null_rate", "DATA_QUALITY", False, 0.05, 0.15, "rate"),
    ("outlier_rate", "DATA_QUALITY", False, 0.05, 0.15, "rate"),
    ("leakage_score", "LEAKAGE", False, 0.50, 0.70, "score"),
    ("mutual_info", "LEAKAGE", False, 0.50, 0.70, "mi"),
]


def registry(spark: SparkSession) -> DataFrame:
    """Metric thresholds: one row per known metric."""
    return spark.createDataFrame(
        METRICS, "metric_name string, metric_module string, higher_is_better boolean, warning double, critical double, unit string"
    )


def rank4(severity: Column) -> Column:
    """CRITICAL 3, HIGH 2, MEDIUM 1, everything else 0."""
    s = F.upper(severity)
    return F.when(s == "CRITICAL", 3).when(s == "HIGH", 2).when(s == "MEDIUM", 1).otherwise(0)


def name4(rank: Column) -> Column:
    return F.when(rank == 3, F.lit("CRITICAL")).when(rank == 2, F.lit("HIGH")).when(rank == 1, F.lit("MEDIUM")).otherwise(F.lit("LOW"))


def grade(obs: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """Severity of every observation by the metric's direction and thresholds; unknown metrics are LOW."""
    reg = metrics if metrics is not None else registry(obs.sparkSession)
    v = F.col("metric_value")
    worse = lambda limit: F.when(F.col("higher_is_better"), v <= F.col(limit)).otherwise(v >= F.col(limit))
    severity = F.when(worse("critical"), F.lit("CRITICAL")).when(worse("warning"), F.lit("HIGH")).otherwise(F.lit("LOW"))
    base = obs.drop("severity", "unit", "higher_is_better")
    # The registry holds a few dozen rows.
    return base.join(F.broadcast(reg.select("metric_name", "higher_is_better", "warning", "critical", "unit")), "metric_name", "left").select(
        *base.columns, severity.alias("severity"), F.coalesce("higher_is_better", F.lit(True)).alias("higher_is_better"), "unit"
    )


def run_index(runs: DataFrame, slices: int = SLICES) -> DataFrame:
    """Chronological index of each run inside its lineage, without sorting a lineage in one task."""
    keyed = runs.withColumn("_order", F.struct("created_at", "run_id")).withColumn("_one", F.lit(1))
    out = running_totals(keyed, ["lineage_id"], "_order", ["_one"], slices, bounded_keys=False)
    return out.select(*runs.columns, F.col("lt__one").cast("int").alias("run_index"))


def extract_observations(norm: DataFrame, runs: DataFrame) -> DataFrame:
    """Normalised metrics (run_id, module, metric_name, target_type, target_key, metric_value) placed on the lineage's
    time line and graded; NaN and infinite values are dropped."""
    placed = run_index(runs).select("run_id", "lineage_id", "run_type", "run_index", F.col("created_at").alias("ts"))
    clean = norm.withColumn("metric_value", finite(F.col("metric_value"))).filter(F.col("metric_value").isNotNull())
    return grade(clean.join(placed, "run_id"))


def positions(obs: DataFrame, keys: Sequence[str] = SERIES, value: str = "metric_value", slices: int = SLICES) -> DataFrame:
    """Add ``pos`` (0-based index in the series), ``n``, prefix sums ``s1``, ``s2`` before the point, totals ``t1``, ``t2``."""
    v = F.col(value)
    prepared = obs.withColumns({"_one": F.lit(1), "_v": v, "_v2": v * v})
    out = running_totals(prepared, keys, "run_index", ["_one", "_v", "_v2"], slices, bounded_keys=False)
    return out.select(
        *obs.columns,
        F.col("lt__one").alias("pos"), F.col("tot__one").alias("n"),
        F.col("lt__v").alias("s1"), F.col("lt__v2").alias("s2"), F.col("tot__v").alias("t1"), F.col("tot__v2").alias("t2"),
    )


def metric_history(obs: DataFrame) -> DataFrame:
    """Per series: size, moments, range, latest and previous value, baseline window and deviation."""
    p = positions(obs)
    v, pos, n = F.col("metric_value"), F.col("pos"), F.col("n")
    window = F.greatest(F.lit(1), F.least(F.lit(5), F.floor(n / 2)))
    first = F.when(pos < window, v)
    out = p.groupBy(*SERIES).agg(
        F.max("n").alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.max(F.when(pos == n - 1, v)).alias("latest"),
        F.coalesce(F.max(F.when(pos == n - 2, v)), F.max(F.when(pos == n - 1, v))).alias("previous"),
        F.avg(first).alias("baseline_mean"),
        F.stddev_pop(first).alias("baseline_std"),
    )
    middle = exact_quantiles(
        cumulative_counts(obs, SERIES, "metric_value", {"k": F.lit(1)}, SLICES, bounded_keys=False), SERIES, "metric_value", "k", {"median": 0.5}
    ).drop("n")
    delta = F.col("latest") - F.col("previous")
    return out.join(middle, SERIES).select(
        *SERIES, "n", "mean", "median", "std",
        F.when(F.abs("mean") > 1e-6, F.col("std") / F.abs("mean")).otherwise(F.lit(0.0)).alias("cv"),
        "min", "max", "latest", "previous", delta.alias("delta"),
        (delta / F.greatest(F.abs("previous"), F.lit(1e-6))).alias("relative_delta"),
        "baseline_mean", "baseline_std",
        F.when(F.col("baseline_std") > 1e-6, (F.col("latest") - F.col("baseline_mean")) / F.col("baseline_std"))
        .otherwise(F.lit(0.0)).alias("standardized_latest"),
    )


def direction(n: Column, slope: Column, r2: Column, cv: Column, spread: Column, higher: Column) -> Column:
    good = F.when(higher, slope).otherwise(-slope)
    return (
        F.when(n < 3, F.lit("INSUFFICIENT_DATA"))
        .when((cv > 0.30) & (r2 < 0.25) & (spread > 0.10), F.lit("VOLATILE"))
        .when(good > 0.005, F.lit("IMPROVING"))
        .when(good < -0.005, F.lit("DEGRADING"))
        .otherwise(F.lit("STABLE"))
    )


def trend(obs: DataFrame) -> DataFrame:
    """Least-squares slope over the index, R squared and direction per series (needs ``higher_is_better``)."""
    p = positions(obs)
    v, x = F.col("metric_value"), F.col("pos").cast("double")
    out = p.groupBy(*SERIES).agg(
        F.max("n").alias("n"),
        F.coalesce(F.regr_slope(v, x), F.lit(0.0)).alias("slope"),
        F.coalesce(F.when(F.max(v) > F.min(v), F.regr_r2(v, x)), F.lit(0.0)).alias("r2"),
        F.avg(v).alias("_mean"),
        F.stddev_pop(v).alias("_std"),
        (F.max(v) - F.min(v)).alias("_spread"),
        F.max("higher_is_better").alias("_higher"),
    )
    cv = F.when(F.abs("_mean") > 1e-6, F.col("_std") / F.abs("_mean")).otherwise(F.lit(0.0))
    short = F.col("n") < 3
    return out.select(
        *SERIES, "n",
        F.when(short, F.lit(0.0)).otherwise(F.col("slope")).alias("slope"),
        F.when(short, F.lit(0.0)).otherwise(F.col("r2")).alias("r2"),
        direction(F.col("n"), F.col("slope"), F.col("r2"), cv, F.col("_spread"), F.col("_higher")).alias("direction"),
    )


def mann_kendall(obs: DataFrame, slices: int = SLICES) -> DataFrame:
    """Mann-Kendall S, tau, z and p per series, without forming pairs.

    Values are replaced by their rank. Two points differ first at some bit of
    their ranks; at that bit, inside the group that shares the higher bits, the
    pair is ascending if the earlier point has 0 and the later 1. Running totals
    over time count those pairs, so the cost is n log n. Values closer than 1e-9
    count as tied.
    """
    v = obs.select(*SERIES, "run_index", F.round("metric_value", 9).alias("v"))
    values = cumulative_counts(v, SERIES, "v", {"k": F.lit(1).cast("long")}, slices, bounded_keys=False)
    k = F.col("k").cast("double")
    per = values.groupBy(*SERIES).agg(F.max("tot_k").alias("n"), F.sum(k * (k - 1) * (k * 2 + 5)).alias("_ties"))
    return kendall_test(per.join(ascents(v, 5, slices, values), SERIES, "left"))


def ascents(v: DataFrame, least: int, slices: int = SLICES, values: DataFrame | None = None) -> DataFrame:
    """Ascending less descending pairs ``s`` per series of ``least`` points or more."""
    if values is None:
        values = cumulative_counts(v, SERIES, "v", {"k": F.lit(1).cast("long")}, slices, bounded_keys=False)
    ranked = v.join(values.select(*SERIES, "v", F.col("lt_k").alias("rank"), F.col("tot_k").alias("n")), [*SERIES, "v"]).filter(F.col("n") >= least)
    bits = F.length(F.bin(F.col("n")))
    spread = ranked.withColumn("_bit", F.explode(F.sequence(F.lit(0), bits - 1)))
    high = F.expr("shiftright(rank, _bit + 1)")
    one = F.expr("shiftright(rank, _bit) & 1")
    keyed = spread.select(*SERIES, "run_index", "_bit", high.alias("_high"), one.alias("_up"), (F.lit(1) - one).alias("_down"))
    counted = running_totals(keyed, [*SERIES, "_bit", "_high"], "run_index", ["_up", "_down"], slices, bounded_keys=False)
    return counted.groupBy(*SERIES).agg(
        F.sum(F.when(F.col("_up") == 1, F.col("lt__down")).otherwise(-F.col("lt__up"))).alias("s")
    )


def kendall_test(per: DataFrame) -> DataFrame:
    """tau, z, p and trend from ``n``, ``_ties`` and ``s`` per series."""
    n = F.col("n").cast("double")
    var = F.greatest((n * (n - 1) * (n * 2 + 5) - F.col("_ties")) / 18, F.lit(1e-9))
    z = F.coalesce((F.col("s") - F.signum(F.col("s").cast("double"))) / F.sqrt(var), F.lit(0.0))
    enough = F.col("n") >= 5
    return (
        per.withColumn("s", F.when(enough, F.col("s")))
        .select(
            *SERIES, "n", F.coalesce("s", F.lit(0)).cast("long").alias("s"),
            F.coalesce(F.col("s") * 2 / (n * (n - 1)), F.lit(0.0)).alias("tau"),
            F.when(enough, z).otherwise(F.lit(0.0)).alias("z"),
        )
        .withColumn("p", F.when(enough, normal_p(F.col("z"))).otherwise(F.lit(1.0)))
        .withColumn(
            "trend",
            F.when(~enough, F.lit("INSUFFICIENT_DATA"))
            .when((F.col("p") < 0.05) & (F.col("s") > 0), F.lit("INCREASING"))
            .when((F.col("p") < 0.05) & (F.col("s") < 0), F.lit("DECREASING"))
            .otherwise(F.lit("NO_TREND")),
        )
    )


def change_point(obs: DataFrame, min_split: int = 2, min_shift: float = 0.05) -> DataFrame:
    """The split with the largest weighted mean shift per series, where the shift reaches ``min_shift``."""
    return best_split(positions(obs), min_split, min_shift)


def best_split(p: DataFrame, min_split: int, min_shift: float) -> DataFrame:
    """The change point from points with their prefix sums and totals."""
    k, n = F.col("pos").cast("double"), F.col("n").cast("double")
    before, after = F.try_divide(F.col("s1"), k), F.try_divide(F.col("t1") - F.col("s1"), n - k)
    shift = after - before
    within = F.greatest(F.col("t2") - k * before * before - (n - k) * after * after, F.lit(0.0)) / n
    ok = (k >= min_split) & (n - k >= min_split) & (F.abs(shift) >= min_shift)
    # Scores are compared at nine digits; the earliest split wins ties.
    score = F.round(F.abs(shift) * F.sqrt(k * (n - k) / n), 9)
    cell = F.struct(F.col("pos").alias("change_index"), "run_id", "run_index", before.alias("before_mean"), after.alias("after_mean"),
                    shift.alias("shift"), within.alias("_var"))
    best = p.filter(ok).groupBy(*SERIES).agg(F.max_by(cell, F.struct(score, -F.col("pos"))).alias("b"))
    z = F.abs("b.shift") / F.sqrt(F.greatest(F.col("b._var"), F.lit(1e-6)))
    size = F.abs("b.shift")
    return best.select(
        *SERIES,
        F.col("b.change_index").alias("change_index"), F.col("b.run_id").alias("run_id"), F.col("b.run_index").alias("run_index"),
        F.col("b.before_mean").alias("before_mean"), F.col("b.after_mean").alias("after_mean"), F.col("b.shift").alias("shift"),
        (F.col("b.shift") / F.greatest(F.abs("b.before_mean"), F.lit(1e-6))).alias("relative_shift"),
        z.alias("z"),
        F.when((z >= 2.5) | (size >= 0.15), F.lit("HIGH")).when(z >= 1.5, F.lit("MEDIUM")).otherwise(F.lit("LOW")).alias("confidence"),
    )


def split_means(obs: DataFrame) -> DataFrame:
    """Mean before and from each point on: the search table behind ``change_point``."""
    p = positions(obs)
    k, n = F.col("pos"), F.col("n")
    return p.select(
        *SERIES, "run_index", "pos",
        F.try_divide(F.col("s1"), k.cast("double")).alias("before_mean"),
        F.try_divide(F.col("t1") - F.col("s1"), (n - k).cast("double")).alias("after_mean"),
    )


def target_runs(obs: DataFrame) -> DataFrame:
    """Worst severity per target and run; GLOBAL and empty targets carry no issue."""
    keep = F.col("target_key").isNotNull() & ~F.upper(F.trim("target_key")).isin("", "GLOBAL", "NONE")
    return obs.filter(keep).groupBy(*TARGET, "run_id", "run_index").agg(
        F.max(rank4(F.col("severity"))).alias("rank"), F.count(F.lit(1)).alias("observations")
    )


def persistence(seq: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    """Classify a severity history (keys, run_index, rank 0-3).

    A strictly monotone history over four ranks has at most four points, so the
    first four ranks decide it; streaks are distances to the last point that
    breaks them. Everything is one aggregate.
    """
    return classify_streaks(streaks(seq, keys), keys)


def streaks(seq: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    """What decides the class: ends, first ranks, last points that break a streak, elevated points."""
    prepared = seq.withColumn("_one", F.lit(1))
    p = running_totals(prepared, keys, "run_index", ["_one"], SLICES, bounded_keys=False)
    pos, n, r = F.col("lt__one"), F.col("tot__one"), F.col("rank")
    up = r >= 2
    last = lambda c: F.coalesce(F.max(F.when(c, pos)), F.lit(-1))
    return p.groupBy(*keys).agg(
        F.max("tot__one").alias("n"),
        F.max(F.when(pos == n - 1, r)).alias("cur"),
        F.coalesce(F.max(F.when(pos == n - 2, r)), F.max(F.when(pos == n - 1, r))).alias("prev"),
        F.max(r).alias("peak"),
        *[F.max(F.when(pos == i, r)).alias(f"r{i}") for i in range(4)],
        *[last(r != i).alias(f"not{i}") for i in range(4)],
        last(~up).alias("not_up"),
        F.count_if(up).alias("elevated"),
        F.min(F.when(up, pos)).alias("first_up"),
        F.max(F.when(up, pos)).alias("last_up"),
    )


def classify_streaks(agg: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    cur = F.col("cur")
    same = F.when(cur == 0, F.col("not0")).otherwise(F.col("not1"))
    streak = F.col("n") - 1 - F.when(cur >= 2, F.col("not_up")).otherwise(same)
    r = [F.col(f"r{i}") for i in range(4)]
    short = F.col("n").isin(3, 4)
    rising = short & (r[0] < r[1]) & (r[1] < r[2]) & ((F.col("n") == 3) | (r[2] < r[3]))
    falling = short & (r[0] > r[1]) & (r[1] > r[2]) & ((F.col("n") == 3) | (r[2] > r[3]))
    gap = (F.col("elevated") >= 2) & (F.col("last_up") - F.col("first_up") + 1 > F.col("elevated"))
    status = (
        F.when(rising & (cur >= 2), F.lit("ESCALATING"))
        .when(falling & (cur <= 1), F.lit("DEESCALATING"))
        .when((cur <= 1) & (F.col("peak") >= 2) & (F.col("streak") >= 2), F.lit("RECOVERED"))
        .when((cur <= 1) & (F.col("peak") >= 2) & (F.col("elevated") == 1), F.lit("TRANSIENT"))
        .when((cur >= 2) & (F.col("streak") >= 3), F.lit("PERSISTENT"))
        .when((cur >= 2) & gap, F.lit("RECURRING"))
        .when((cur >= 2) & (F.col("elevated") <= 2), F.lit("EMERGING"))
        .when((cur >= 2) & (F.col("elevated") >= 3), F.lit("PERSISTENT"))
        .when(cur >= 2, F.lit("EMERGING"))
        .otherwise(F.lit("TRANSIENT"))
    )
    return agg.withColumn("streak", streak).select(
        *keys, F.col("n").alias("runs"),
        name4(cur).alias("current_severity"), name4(F.col("prev")).alias("previous_severity"), name4(F.col("peak")).alias("peak_severity"),
        F.col("streak").alias("consecutive"), F.col("elevated").alias("elevated_runs"), status.alias("status"),
    )


def severity_transitions(seq: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    """Rows where the severity differs from the run before: an equi-join on key and neighbouring index."""
    p = running_totals(seq.withColumn("_one", F.lit(1)), keys, "run_index", ["_one"], SLICES, bounded_keys=False)
    now = p.select(*keys, "run_index", F.col("lt__one").alias("pos"), F.col("rank").alias("to_rank"))
    before = p.select(*keys, (F.col("lt__one") + 1).alias("pos"), F.col("rank").alias("from_rank"))
    return now.join(before, [*keys, "pos"]).filter(F.col("from_rank") != F.col("to_rank")).select(
        *keys, "run_index", name4(F.col("from_rank")).alias("from_severity"), name4(F.col("to_rank")).alias("to_severity")
    )


def issue_tracks(obs: DataFrame) -> DataFrame:
    """One row per target: first and last sight, modules, metrics, persistence; ranked by severity."""
    keep = F.col("target_key").isNotNull() & ~F.upper(F.trim("target_key")).isin("", "GLOBAL", "NONE")
    facts = obs.filter(keep).groupBy(*TARGET).agg(
        F.min("run_index").alias("first_run_index"), F.max("run_index").alias("last_run_index"),
        F.min_by("run_id", F.struct("run_index", "run_id")).alias("first_run_id"), F.max_by("run_id", F.struct("run_index", "run_id")).alias("last_run_id"),
        F.count(F.lit(1)).alias("observations"),
        # Both sets are bounded by the fixed lists of modules and metrics.
        F.array_sort(F.collect_set("module")).alias("modules"),
        F.array_sort(F.collect_set("metric_name")).alias("metrics"),
    )
    state = persistence(target_runs(obs))
    return facts.join(state, TARGET).orderBy(
        F.desc(rank4(F.col("current_severity"))), F.desc(rank4(F.col("peak_severity"))), F.desc("observations"), *TARGET
    )


def lag_correlation(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("lineage_id",), max_lag: int = 2) -> DataFrame:
    """Pearson r of series a at t - lag with series b at t, for |r| >= .40 (columns: keys, run_index, metric_value)."""
    keys = list(keys)

    def indexed(df: DataFrame, name: str) -> DataFrame:
        p = running_totals(df.withColumn("_one", F.lit(1)), keys, "run_index", ["_one"], SLICES, bounded_keys=False)
        return p.select(*keys, F.col("lt__one").alias("pos"), F.col("tot__one").alias(f"n_{name}"), F.col("metric_value").alias(name))

    left = indexed(a, "x").withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(max_lag)))).withColumn("at", F.col("pos") + F.col("lag"))
    right = indexed(b, "y").withColumnRenamed("pos", "at")
    n = F.least("n_x", "n_y")
    # Keys and position together spread a long series over all tasks.
    both = left.join(right, [*keys, "at"]).filter((F.col("at") < n) & (n >= 4) & (F.col("lag") < n - 2))
    out = both.groupBy(*keys, "lag").agg(
        F.count(F.lit(1)).alias("pairs"), F.corr("x", "y").alias("r"), F.stddev_pop("x").alias("_sx"), F.stddev_pop("y").alias("_sy")
    )
    kept = out.filter((F.col("pairs") >= 3) & (F.col("_sx") >= 1e-6) & (F.col("_sy") >= 1e-6) & (F.abs("r") >= 0.40))
    dof = (F.col("pairs") - 2).cast("double")
    t = F.coalesce(F.try_divide(F.abs("r") * F.sqrt(dof), F.sqrt(F.greatest(F.lit(1.0) - F.col("r") * F.col("r"), F.lit(0.0)))), F.lit(float("inf")))
    return kept.select(
        *keys, "lag", "pairs", "r", student_p(t, dof).alias("p"),
        F.when(F.abs("r") >= 0.70, F.lit("STRONG")).otherwise(F.lit("MODERATE")).alias("strength"),
    )


def durability(experiments: DataFrame, obs: DataFrame, runs: DataFrame) -> DataFrame:
    """Did a validated remediation hold in the later operational runs of its lineage?

    ``experiments``: experiment_id, lineage_id, baseline_run_id, experiment_type, target_key, conclusion.
    TEMPORARY means that some later runs are bad and some are not.
    """
    calibration = F.col("experiment_type").isin("THRESHOLD_COUNTERFACTUAL", "CALIBRATION_COUNTERFACTUAL")
    metric = F.when(~F.col("target_key").startswith("FEATURE::") & calibration, F.lit("expected_calibration_error")).otherwise(F.lit("psi"))
    base = runs.select(F.col("run_id").alias("baseline_run_id"), "lineage_id", F.col("run_index").alias("base_index"))
    exp = experiments.join(base, ["lineage_id", "baseline_run_id"]).withColumn("metric_name", metric)
    ops = obs.filter(F.coalesce(F.col("run_type"), F.lit("BASELINE")) == "BASELINE").select(
        "lineage_id", "metric_name", "target_key", "run_index", "metric_value", "severity"
    )
    keys = ["lineage_id", "metric_name", "target_key"]
    bad = F.col("severity").isin("HIGH", "CRITICAL")
    series = ops.groupBy(*keys, "run_index").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"), F.max("metric_value").alias("metric_value"))
    # Experiments stand in the series right after their base run; what is not before them comes later.
    at = lambda index, kind, who: F.struct(index.alias("i"), F.lit(kind).alias("k"), who.alias("id"))
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    points = series.select(*keys, at(F.col("run_index"), 0, none).alias("_at"), "n", "bad", none.alias("experiment_id"))
    marks = exp.select(*keys, at(F.col("base_index"), 1, F.col("experiment_id").cast("string")).alias("_at"), zero.alias("n"), zero.alias("bad"),
                       F.col("experiment_id").cast("string").alias("experiment_id"))
    placed = running_totals(points.unionByName(marks), keys, "_at", ["n", "bad"], SLICES, bounded_keys=False).filter(F.col("experiment_id").isNotNull())
    last = series.groupBy(*keys).agg(F.max("run_index").alias("_last"), F.max_by("metric_value", "run_index").alias("_value"))
    start = exp.join(series.select(*keys, F.col("run_index").alias("base_index"), "metric_value"), [*keys, "base_index"]).select(
        F.col("experiment_id").cast("string").alias("_eid"), F.col("metric_value").alias("baseline_value"))
    out = placed.select(
        F.col("experiment_id").alias("_eid"), (F.col("tot_n") - F.col("lt_n")).alias("followups"), (F.col("tot_bad") - F.col("lt_bad")).alias("regressed")
    ).join(start, "_eid", "left")
    exp = exp.join(last, keys, "left").withColumn("latest_value", F.when(F.col("_last") > F.col("base_index"), F.col("_value")))
    status = (
        F.when(F.col("conclusion") != "VALIDATED", F.lit("NOT_APPLICABLE"))
        .when(F.coalesce("followups", F.lit(0)) == 0, F.lit("INSUFFICIENT_FOLLOWUP"))
        .when(F.col("regressed") == 0, F.lit("SUSTAINED"))
        .when(F.col("regressed") == F.col("followups"), F.lit("FAILED_TO_SUSTAIN"))
        .otherwise(F.lit("TEMPORARY"))
    )
    return exp.join(out, F.col("experiment_id").cast("string") == F.col("_eid"), "left").select(
        "experiment_id", "lineage_id", "target_key", "metric_name", "conclusion", "baseline_value", "latest_value",
        F.coalesce("followups", F.lit(0)).alias("followups"), F.coalesce("regressed", F.lit(0)).alias("regressed"), status.alias("status"),
    )


ALERT_COLUMNS = ["lineage_id", "alert_type", "priority", "target_type", "target_key", "metric_name", "current_value", "reference_value",
                 "confidence", "source_module"]


def temporal_alerts(tracks: DataFrame, change_points: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Alerts from issue tracks, change points and remediations that did not hold."""
    s, cur = F.col("status"), F.col("current_severity")
    severe = F.when(cur == "CRITICAL", F.lit("CRITICAL")).otherwise(F.lit("HIGH"))
    first_metric = F.coalesce(F.try_element_at("metrics", F.lit(1)), F.lit("composite"))

    def alert(kind: str, priority, confidence: str, metric=first_metric):
        return F.struct(
            F.lit(kind).alias("alert_type"), (priority if not isinstance(priority, str) else F.lit(priority)).alias("priority"),
            metric.alias("metric_name"), F.lit(confidence).alias("confidence"),
        )

    high = cur.isin("HIGH", "CRITICAL")
    cells = F.array(
        F.when(s == "PERSISTENT", alert("PERSISTENT_DEGRADATION", severe, "VERY_HIGH")),
        F.when((s == "EMERGING") & high, alert("NEW_DEGRADATION", severe, "HIGH")),
        F.when(s == "ESCALATING", alert("ESCALATING_DEGRADATION", "CRITICAL", "VERY_HIGH")),
        F.when(s == "RECURRING", alert("RECURRING_ISSUE", "HIGH", "HIGH")),
        F.when(s == "RECOVERED", alert("RECOVERY", "LOW", "HIGH")),
        F.when((F.size("modules") >= 3) & high, alert("MULTI_MODULE_ESCALATION", "CRITICAL", "VERY_HIGH", F.lit("cross_module"))),
    )
    null = F.lit(None).cast("double")
    out = tracks.select("lineage_id", "target_type", "target_key", "modules", F.inline(F.filter(cells, lambda c: c.isNotNull()))).select(
        "lineage_id", "alert_type", "priority", "target_type", "target_key", "metric_name", null.alias("current_value"),
        null.alias("reference_value"), "confidence", F.try_element_at("modules", F.lit(1)).alias("source_module"),
    )
    out = out.unionByName(change_points.select(
        "lineage_id", F.lit("CHANGE_POINT_DETECTED").alias("alert_type"), F.lit("HIGH").alias("priority"), "target_type", "target_key",
        "metric_name", F.col("after_mean").alias("current_value"), F.col("before_mean").alias("reference_value"), "confidence",
        F.col("module").alias("source_module")))
    if held is not None:
        out = out.unionByName(held.filter(F.col("status") == "FAILED_TO_SUSTAIN").select(
            "lineage_id", F.lit("REMEDIATION_NOT_SUSTAINED").alias("alert_type"), F.lit("HIGH").alias("priority"), F.lit("FEATURE").alias("target_type"),
            "target_key", "metric_name", F.col("latest_value").alias("current_value"), F.col("baseline_value").alias("reference_value"),
            F.lit("HIGH").alias("confidence"), F.lit("DRIFT").alias("source_module")))
    return out


def resolve_lineage(ids: DataFrame, runs: DataFrame) -> DataFrame:
    """Map an id that is a run, an artifact or a model name to its lineage, tried in that order."""
    def side(c: str) -> DataFrame:
        return runs.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("id")).agg(F.min("lineage_id").alias(f"_{c}"))

    out = ids
    for c in ("run_id", "artifact_id", "model_name"):
        out = out.join(side(c), "id", "left")
    found = F.coalesce("_run_id", "_artifact_id", "_model_name")
    via = F.when(F.col("_run_id").isNotNull(), F.lit("RUN")).when(F.col("_artifact_id").isNotNull(), F.lit("ARTIFACT")).when(
        F.col("_model_name").isNotNull(), F.lit("MODEL"))
    return out.select(*ids.columns, found.alias("lineage_id"), via.alias("matched_by"))


def history_summary(runs: DataFrame, tracks: DataFrame, alerts: DataFrame) -> DataFrame:
    """Counts per lineage: runs by type, issue tracks by status, critical alerts."""
    experiment = F.col("run_type") == "EXPERIMENT"
    r = runs.groupBy("lineage_id").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(~experiment).alias("baseline_runs"), F.count_if(experiment).alias("experiment_runs")
    )
    s = F.col("status")
    t = tracks.groupBy("lineage_id").agg(
        F.count_if(F.col("current_severity").isin("HIGH", "CRITICAL")).alias("active_issues"),
        F.count_if(s == "PERSISTENT").alias("persistent_issues"),
        F.count_if(s == "EMERGING").alias("emerging_issues"),
        F.count_if(s == "RECURRING").alias("recurring_issues"),
    )
    a = alerts.groupBy("lineage_id").agg(F.count_if(F.col("priority") == "CRITICAL").alias("critical_alerts"))
    out = r.join(t, "lineage_id", "left").join(a, "lineage_id", "left")
    return out.fillna(0)


def timeline(runs: DataFrame, modules: DataFrame) -> DataFrame:
    """Runs in order with their module counts."""
    status = F.col("status")
    m = modules.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("modules"), F.count_if(status == "COMPLETED").alias("completed"), F.count_if(status == "FAILED").alias("failed")
    )
    return runs.select("lineage_id", "run_id", "run_type", "created_at").join(m, "run_id", "left").fillna(0).orderBy(
        "lineage_id", "created_at", "run_id")


def series_deltas(obs: DataFrame) -> DataFrame:
    """Every point with the one before it in its series: an equi-join on series and neighbouring index."""
    p = positions(obs).select(*SERIES, "run_index", "pos", "metric_value")
    prev = p.select(*SERIES, (F.col("pos") + 1).alias("pos"), F.col("metric_value").alias("previous_value"))
    d = F.col("metric_value") - F.col("previous_value")
    return p.join(prev, [*SERIES, "pos"], "left").select(
        *SERIES, "run_index", "metric_value", "previous_value", d.alias("delta"),
        F.try_divide(d, F.greatest(F.abs("previous_value"), F.lit(1e-6))).alias("relative_delta"),
    )

