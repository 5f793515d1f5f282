"""Health dimensions, health state, alert synchronisation and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lifecycle import ALERT_TRANSITIONS, apply_actions
from .predicates import baseline_runs
from .temporal import rank4

# Dimension, module, metric, test, warning, critical.
DIMENSION_RULES = [
    ("DATA_QUALITY", "DATA_QUALITY", "null_rate", "GE", 0.05, 0.20),
    ("DATA_QUALITY", "DATA_QUALITY", "outlier_rate", "GE", 0.10, None),
    ("LEAKAGE", "LEAKAGE", "leakage_score", "GE", 0.50, 0.80),
    ("DRIFT", "DRIFT", "max_psi", "GE", 0.10, 0.25),
    ("DRIFT", "DRIFT", "psi", "GE", 0.10, 0.25),
    ("PERFORMANCE", "PERFORMANCE", "f1", "LT", 0.75, 0.60),
    ("PERFORMANCE", "PERFORMANCE", "roc_auc", "LT", 0.80, 0.65),
    ("PERFORMANCE", "PERFORMANCE", "log_loss", "GT", 0.50, 0.80),
    ("CALIBRATION", "PERFORMANCE", "expected_calibration_error", "GT", 0.08, 0.15),
    ("CALIBRATION", "PERFORMANCE", "brier_score", "GT", 0.25, None),
    ("ERROR", "ERROR_FORENSICS", "high_confidence_error_rate", "GT", 0.05, 0.15),
    ("ERROR", "ERROR_FORENSICS", "overall_error_rate", "GT", 0.25, 0.40),
    ("ERROR", "ERROR_FORENSICS", "error_association", "GE", 0.25, 0.45),
    ("FAIRNESS", "BIAS", "worst_disparate_impact_ratio", "LT", 0.80, 0.65),
    ("FAIRNESS", "BIAS", "demographic_parity_gap", "GT", 0.15, 0.30),
    ("ROBUSTNESS", "ROBUSTNESS", "gaussian_jitter_5pct_flip_rate", "GT", 0.05, 0.15),
    ("ROBUSTNESS", "ROBUSTNESS", "boundary_flip_rate", "GT", 0.10, 0.25),
    ("ROBUSTNESS", "ROBUSTNESS", "flip_rate", "GE", 0.10, 0.20),
]
DIMENSIONS = ["DATA_QUALITY", "LEAKAGE", "DRIFT", "PERFORMANCE", "CALIBRATION", "ERROR", "FAIRNESS", "ROBUSTNESS", "TEMPORAL"]
DIMENSION_MODULE = {
    "DATA_QUALITY": "DATA_QUALITY", "LEAKAGE": "LEAKAGE", "DRIFT": "DRIFT", "PERFORMANCE": "PERFORMANCE", "CALIBRATION": "PERFORMANCE",
    "ERROR": "ERROR_FORENSICS", "FAIRNESS": "BIAS", "ROBUSTNESS": "ROBUSTNESS",
}
# Defaults of a monitoring policy.
POLICY = {"min_runs": 3, "persistence_runs": 2, "recovery_runs": 2, "cooldown_runs": 1, "hysteresis": 0.05}


def dimension_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        DIMENSION_RULES, "dimension string, rule_module string, metric_name string, test string, warning double, critical double")


def dimension_evidence(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Graded metric rows (NOMINAL, WARNING, CRITICAL) per dimension. The rule table holds a few dozen rows."""
    v = F.col("metric_value")

    def hit(limit: str) -> Column:
        x = F.col(limit)
        return F.coalesce(F.when(F.col("test") == "GE", v >= x).when(F.col("test") == "GT", v > x).otherwise(v < x), F.lit(False))

    grade = F.when(hit("critical"), F.lit("CRITICAL")).when(hit("warning"), F.lit("WARNING")).otherwise(F.lit("NOMINAL"))
    joined = metrics.join(F.broadcast(dimension_rules(metrics.sparkSession)), "metric_name")
    # A zero share of the quality metrics and a zero performance score mean "not measured".
    return joined.filter(v.isNotNull() & ((F.col("test") != "LT") | (v > 0))).select(
        *keys, "dimension", "metric_name", "target_key", "metric_value", grade.alias("grade"))


def temporal_evidence(trends: DataFrame, tracks: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """lineage_id, reason, target_key, grade: what the TEMPORAL dimension rests on. ``trends`` needs direction and severity."""
    grade = lambda c: F.when(c == "CRITICAL", F.lit("CRITICAL")).otherwise(F.lit("WARNING"))
    out = trends.filter(F.col("direction") == "DEGRADING").select("lineage_id", F.lit("trend").alias("reason"), "target_key", grade(F.col("severity")).alias("grade"))
    out = out.unionByName(tracks.filter(F.col("status").isin("PERSISTENT", "ESCALATING")).select(
        "lineage_id", F.lit("track").alias("reason"), "target_key", grade(F.col("current_severity")).alias("grade")))
    if held is not None:
        out = out.unionByName(held.filter(F.col("status").isin("FAILED_TO_SUSTAIN", "TEMPORARY")).select(
            "lineage_id", F.lit("durability").alias("reason"), "target_key", F.lit("WARNING").alias("grade")))
    return out


def health_dimensions(metrics: DataFrame, keys: list[str], temporal: DataFrame | None = None) -> DataFrame:
    """keys, dimension, state, evidence rows. ``metrics``: keys, module, metric_name, target_key, metric_value.

    Worst grade wins: CRITICAL, else DEGRADED for a warning, else HEALTHY; UNKNOWN
    when the module did not run. ``temporal`` (keys, grade) fills the last dimension.
    """
    ev = dimension_evidence(metrics, keys).groupBy(*keys, "dimension").agg(
        F.max(F.when(F.col("grade") == "CRITICAL", 2).when(F.col("grade") == "WARNING", 1).otherwise(0)).alias("worst"),
        F.count_if(F.col("grade") != "NOMINAL").alias("evidence"))
    spine = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(m).alias("_module")) for d, m in DIMENSION_MODULE.items()])
    have = metrics.groupBy(*keys).agg(F.collect_set("module").alias("_have")).select(*keys, "_have", F.inline(spine))
    out = have.join(ev, [*keys, "dimension"], "left").select(
        *keys, "dimension",
        F.when(~F.array_contains("_have", F.col("_module")), F.lit("UNKNOWN")).when(F.col("worst") == 2, F.lit("CRITICAL"))
        .when(F.col("worst") == 1, F.lit("DEGRADED")).otherwise(F.lit("HEALTHY")).alias("state"),
        F.coalesce("evidence", F.lit(0)).alias("evidence"))
    if temporal is not None:
        t = temporal.groupBy(*[k for k in keys if k in temporal.columns]).agg(
            F.max(F.when(F.col("grade") == "CRITICAL", 2).otherwise(1)).alias("worst"), F.count(F.lit(1)).alias("evidence"))
        rows = metrics.select(*keys).distinct().join(t, [k for k in keys if k in temporal.columns], "left")
        out = out.unionByName(rows.select(
            *keys, F.lit("TEMPORAL").alias("dimension"),
            F.when(F.col("worst") == 2, F.lit("CRITICAL")).when(F.col("worst") == 1, F.lit("DEGRADED")).otherwise(F.lit("HEALTHY")).alias("state"),
            F.coalesce("evidence", F.lit(0)).alias("evidence")))
    return out


def with_policy(df: DataFrame, policies: DataFrame | None) -> DataFrame:
    """Attach each lineage's policy, defaults where it has none."""
    if policies is None:
        return df.withColumns({k: F.lit(v) for k, v in POLICY.items()})
    out = df.join(policies.select("lineage_id", *[F.col(k).alias(f"_{k}") for k in POLICY]), "lineage_id", "left")
    return out.select(*df.columns, *[F.coalesce(F.col(f"_{k}"), F.lit(v)).alias(k) for k, v in POLICY.items()])


def health_decision(dims: DataFrame, run_counts: DataFrame, alerts: DataFrame | None = None, previous: DataFrame | None = None,
                    policies: DataFrame | None = None) -> DataFrame:
    """Health index and state per lineage.

    ``dims``: lineage_id, dimension, state. ``run_counts``: lineage_id, baseline_runs.
    ``alerts``: lineage_id, current_severity, lifecycle_state. ``previous``: lineage_id, previous_state.
    """
    s = F.col("state")
    d = dims.groupBy("lineage_id").agg(
        F.count_if(s == "CRITICAL").alias("critical_dims"), F.count_if(s == "DEGRADED").alias("degraded_dims"),
        F.count_if(s == "WARNING").alias("warning_dims"), F.count_if(s == "UNKNOWN").alias("unknown_dims"))
    out = with_policy(run_counts, policies).join(d, "lineage_id", "left")
    if alerts is not None:
        sev = F.col("current_severity")
        active = alerts.filter(~F.col("lifecycle_state").isin("RESOLVED", "SUPPRESSED"))
        a = active.groupBy("lineage_id").agg(
            F.count_if(sev == "CRITICAL").alias("critical_alerts"), F.count_if(sev.isin("HIGH", "WARNING")).alias("high_alerts"), F.count_if(sev == "MEDIUM").alias("medium_alerts"))
        out = out.join(a, "lineage_id", "left")
    else:
        out = out.withColumns({c: F.lit(0) for c in ("critical_alerts", "high_alerts", "medium_alerts")})
    out = out.join(previous, "lineage_id", "left") if previous is not None else out.withColumn("previous_state", F.lit(None).cast("string"))
    counts = ["critical_dims", "degraded_dims", "warning_dims", "unknown_dims", "critical_alerts", "high_alerts", "medium_alerts"]
    out = out.fillna(0, counts)
    c = {n: F.col(n) for n in counts}
    penalty = (c["critical_dims"] * 25 + c["degraded_dims"] * 15 + c["warning_dims"] * 8 + c["unknown_dims"] * 10
               + c["critical_alerts"] * 10 + c["high_alerts"] * 5 + c["medium_alerts"] * 2)
    few = F.col("baseline_runs") < F.col("min_runs")
    state = (
        F.when(few | (c["unknown_dims"] >= 3), F.lit("UNKNOWN"))
        .when((c["critical_alerts"] > 0) | (c["critical_dims"] > 0), F.lit("CRITICAL"))
        .when((c["high_alerts"] > 0) | (c["degraded_dims"] > 0) | (c["warning_dims"] >= 3), F.lit("DEGRADED"))
        .when(F.col("previous_state").isin("CRITICAL", "DEGRADED"), F.lit("RECOVERING"))
        .otherwise(F.lit("HEALTHY"))
    )
    index = F.when(few, F.lit(60)).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - penalty)))
    return out.select("lineage_id", "baseline_runs", *counts, index.cast("long").alias("health_index"), state.alias("health_state"))


def health_snapshots(decision: DataFrame, run_id: Column) -> DataFrame:
    """Snapshot rows, one per (lineage, run): write them with ``write_partition`` to overwrite on recompute."""
    return decision.select("lineage_id", run_id.alias("run_id"), "health_state", "health_index", "critical_dims", "degraded_dims", "unknown_dims",
                           (F.col("critical_alerts") + F.col("high_alerts") + F.col("medium_alerts")).alias("active_alerts"))


def operational_runs(runs: DataFrame) -> DataFrame:
    return baseline_runs(runs)


def fingerprint(df: DataFrame) -> Column:
    parts = [F.coalesce(F.col(c), F.lit("GLOBAL")) for c in ("lineage_id", "alert_type", "target_type", "target_key", "metric_name")]
    return F.concat_ws("::", *parts)


STATE = ["alert_fingerprint", "lineage_id", "alert_type", "target_type", "target_key", "metric_name", "source_module", "current_severity", "previous_severity",
         "severity_change", "lifecycle_state", "current_value", "reference_value", "first_seen_run_id", "last_seen_run_id", "occurrence_count", "consecutive_count",
         "escalation_count", "recovery_count", "reopen_count", "suppressed_until"]
STATE_SCHEMA = ("alert_fingerprint string, lineage_id string, alert_type string, target_type string, target_key string, metric_name string, source_module string, "
                "current_severity string, previous_severity string, severity_change string, lifecycle_state string, current_value double, reference_value double, "
                "first_seen_run_id string, last_seen_run_id string, occurrence_count long, consecutive_count long, escalation_count long, recovery_count long, "
                "reopen_count long, suppressed_until timestamp")


def _synchronised(state: DataFrame, incoming: DataFrame, run_id: Column, now: Column) -> DataFrame:
    fresh = incoming.withColumn("alert_fingerprint", fingerprint(incoming)).withColumn("severity", F.coalesce("priority", F.lit("MEDIUM")))
    # Two alerts of one run with one fingerprint are one alert: the more severe counts.
    n = fresh.groupBy("alert_fingerprint").agg(F.max_by(F.struct(
        "lineage_id", "alert_type", F.coalesce("target_type", F.lit("GLOBAL")).alias("target_type"), F.coalesce("target_key", F.lit("GLOBAL")).alias("target_key"),
        "metric_name", "source_module", "severity", "current_value", "reference_value"), rank4(F.col("severity"))).alias("n"))
    o = state.select("alert_fingerprint", F.struct(*[c for c in STATE if c != "alert_fingerprint"]).alias("o"))
    both = o.join(n, "alert_fingerprint", "full_outer")
    known, seen = F.col("o").isNotNull(), F.col("n").isNotNull()
    life = F.col("o.lifecycle_state")
    expired = (life == "SUPPRESSED") & F.coalesce(F.col("o.suppressed_until") < now, F.lit(False))
    reopened = life == "RESOLVED"
    step = F.when(known, F.signum((rank4(F.col("n.severity")) - rank4(F.col("o.current_severity"))).cast("double"))).otherwise(F.lit(0.0))
    resolve = known & ~seen & life.isin("OPEN", "ACKNOWLEDGED", "INVESTIGATING", "REOPENED")
    new_life = (
        F.when(~known, F.lit("OPEN")).when(resolve, F.lit("RESOLVED")).when(~seen, life)
        .when(expired, F.lit("OPEN")).when(reopened, F.lit("REOPENED")).otherwise(life)
    )
    pick = lambda c: F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    old = lambda c: F.coalesce(F.col(f"o.{c}"), F.lit(0))
    change = F.when(~known, F.lit("NEW")).when(~seen, F.col("o.severity_change")).when(step > 0, F.lit("ESCALATED")).when(step < 0, F.lit("DEESCALATED")).otherwise(F.lit("UNCHANGED"))
    event = lambda when, kind, a, b: F.when(when, F.struct(F.lit(kind).alias("event"), a.alias("from_value"), b.alias("to_value")))
    null = F.lit(None).cast("string")
    events = F.filter(F.array(
        event(~known, "CREATE", null, F.lit("OPEN")),
        event(known & seen & expired, "SUPPRESSION_EXPIRED", life, F.lit("OPEN")),
        event(known & seen & reopened, "REOPEN", life, F.lit("REOPENED")),
        event(known & seen & (step > 0), "ESCALATE", F.col("o.current_severity"), F.col("n.severity")),
        event(known & seen & (step < 0), "DEESCALATE", F.col("o.current_severity"), F.col("n.severity")),
        event(resolve, "AUTO_RESOLVE", life, F.lit("RESOLVED")),
    ), lambda e: e.isNotNull())
    one = lambda c: c.cast("long")
    return both.select(
        "alert_fingerprint", *[pick(c).alias(c) for c in ("lineage_id", "alert_type", "target_type", "target_key", "metric_name", "source_module")],
        F.when(seen, F.col("n.severity")).otherwise(F.col("o.current_severity")).alias("current_severity"),
        F.when(known & seen, F.col("o.current_severity")).otherwise(F.col("o.previous_severity")).alias("previous_severity"),
        change.alias("severity_change"), new_life.alias("lifecycle_state"), pick("current_value").alias("current_value"), pick("reference_value").alias("reference_value"),
        F.coalesce(F.col("o.first_seen_run_id"), run_id).alias("first_seen_run_id"), F.when(seen, run_id).otherwise(F.col("o.last_seen_run_id")).alias("last_seen_run_id"),
        one(old("occurrence_count") + seen.cast("int")).alias("occurrence_count"),
        one(F.when(seen, old("consecutive_count") + 1).otherwise(F.lit(0))).alias("consecutive_count"),
        one(old("escalation_count") + (step > 0).cast("int")).alias("escalation_count"),
        one(old("recovery_count") + F.when(seen & known & (step < 0), 1).when(resolve, 1).otherwise(0)).alias("recovery_count"),
        one(old("reopen_count") + F.coalesce((known & seen & reopened).cast("int"), F.lit(0))).alias("reopen_count"),
        F.when(expired & seen, F.lit(None)).otherwise(F.col("o.suppressed_until")).cast("timestamp").alias("suppressed_until"),
        events.alias("events"),
    )


def sync_alerts(state: DataFrame, incoming: DataFrame, run_id: Column, now: Column) -> tuple[DataFrame, DataFrame]:
    """New alert state and the audit events of one synchronisation: one full outer join on the fingerprint."""
    both = _synchronised(state, incoming, run_id, now)
    events = both.select("alert_fingerprint", "lineage_id", F.inline("events")).withColumn("at", now)
    return both.select(*STATE), events


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE_SCHEMA)


def act_on_alerts(state: DataFrame, actions: DataFrame) -> DataFrame:
    """Verdicts of operator actions on alerts (alert_fingerprint, action_id, acted_at, target_state)."""
    return apply_actions(state, actions, "alert_fingerprint", ALERT_TRANSITIONS)


def link_alerts(alerts: DataFrame, related: DataFrame, kind: str) -> DataFrame:
    """Attach the first related row (by priority, then id) with the same run lineage and target.

    ``related``: lineage_id, target_key, id, priority_order.
    """
    best = related.groupBy("lineage_id", "target_key").agg(F.min_by("id", F.struct("priority_order", "id")).alias(f"{kind}_id"))
    return alerts.join(best, ["lineage_id", "target_key"], "left")
