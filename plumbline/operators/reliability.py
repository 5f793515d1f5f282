"""Reliability of a model lineage over its history, and governance of the fleet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cumulative import running_totals

CHUNK = 500
START = 95.0
WIDE = 1e9  # stands for "no bound"


def _steps(df: DataFrame) -> DataFrame:
    """Each run as a clamp x -> max(low, min(x + shift, high))."""
    h, i = F.col("health_state"), F.col("health_index").cast("double")
    shift = F.when(h == "CRITICAL", -15.0).when(h == "DEGRADED", -8.0).when(h == "RECOVERING", 6.0).otherwise(4.0)
    low = F.when(h == "CRITICAL", 30.0).when(h == "DEGRADED", 50.0).otherwise(-WIDE)
    high = F.when(h == "CRITICAL", F.greatest(F.lit(30.0), i)).when(h == "DEGRADED", F.greatest(F.lit(50.0), i)).when(h == "RECOVERING", 85.0).otherwise(100.0)
    return df.withColumns({"_shift": shift, "_low": low, "_high": high})


def trajectory(snapshots: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Running reliability score per run. ``snapshots``: lineage_id, run_id, run_index, health_state, health_index.

    The clamps of consecutive runs compose to one clamp, so a history is cut into
    chunks of bounded size, chunk clamps give every chunk its starting score, and
    each chunk is replayed on its own.
    """
    placed = running_totals(_steps(snapshots).withColumn("_one", F.lit(1)), ["lineage_id"], "run_index", ["_one"], bounded_keys=False)
    item = F.struct("run_index", "run_id", "health_state", "health_index", "_shift", "_low", "_high")
    chunks = placed.withColumn("_chunk", F.floor(F.col("lt__one") / chunk)).groupBy("lineage_id", "_chunk").agg(F.array_sort(F.collect_list(item)).alias("_runs"))
    put = lambda x, f: F.greatest(f["_low"], F.least(x + f["_shift"], f["_high"]))
    clamp = lambda s, lo, hi: F.struct(s.alias("_shift"), lo.alias("_low"), hi.alias("_high"))
    none = clamp(F.lit(0.0), F.lit(-WIDE), F.lit(WIDE))
    maps = chunks.select("lineage_id", "_chunk", F.aggregate(
        "_runs", none, lambda a, f: clamp(a["_shift"] + f["_shift"], put(a["_low"], f), put(a["_high"], f))).alias("_map"))
    # One clamp per chunk: the list is chunk times shorter than the history.
    lists = maps.groupBy("lineage_id").agg(F.array_sort(F.collect_list(F.struct("_chunk", "_map"))).alias("_maps"))
    walked = F.aggregate("_maps", F.array(F.lit(START)), lambda acc, m: F.concat(acc, F.array(put(F.element_at(acc, -1), m["_map"]))))
    begins = lists.select("lineage_id", F.posexplode(F.slice(walked, 1, F.size("_maps"))).alias("_chunk", "_begin"))
    scores = F.slice(F.aggregate("_runs", F.array(F.col("_begin")), lambda acc, f: F.concat(acc, F.array(put(F.element_at(acc, -1), f)))), 2, F.size("_runs"))
    rows = chunks.join(begins, ["lineage_id", "_chunk"]).select("lineage_id", F.inline(F.arrays_zip(F.col("_runs").alias("r"), scores.alias("s"))))
    s, h = F.col("s"), F.col("r.health_state")
    state = (
        F.when((s >= 88) & (h == "HEALTHY"), F.lit("HEALTHY")).when(s >= 75, F.lit("STABLE")).when(s >= 60, F.lit("DEGRADED"))
        .when(s >= 45, F.lit("AT_RISK")).otherwise(F.lit("CRITICAL"))
    )
    return rows.select("lineage_id", F.col("r.run_id").alias("run_id"), F.col("r.run_index").alias("run_index"), h.alias("health_state"),
                       s.alias("score"), state.alias("reliability_state"))


def recovery_profile(traj: DataFrame) -> DataFrame:
    """Degradation periods, recoveries, regressions after a recovery, unresolved periods and recovery rate.

    Edges are found by an equi-join on neighbouring positions, so a long history stays spread out.
    """
    ill = F.col("health_state").isin("CRITICAL", "DEGRADED").cast("int")
    p = running_totals(traj.withColumn("_one", F.lit(1)).withColumn("_ill", ill), ["lineage_id"], "run_index", ["_one"], bounded_keys=False)
    now = p.select("lineage_id", F.col("lt__one").alias("pos"), "_ill", F.col("tot__one").alias("n"))
    before = p.select("lineage_id", (F.col("lt__one") + 1).alias("pos"), F.col("_ill").alias("_was"))
    e = now.join(before, ["lineage_id", "pos"], "left").withColumn("_was", F.coalesce("_was", F.lit(0)))
    start, stop = (F.col("_ill") == 1) & (F.col("_was") == 0), (F.col("_ill") == 0) & (F.col("_was") == 1)
    out = e.groupBy("lineage_id").agg(
        F.max("n").alias("runs"), F.count_if(start).alias("periods"), F.count_if(stop).alias("recoveries"),
        F.max(F.when(F.col("pos") == F.col("n") - 1, F.col("_ill"))).alias("unresolved"))
    # Every period after the first one follows a recovery.
    return out.select(
        "lineage_id", "runs", "periods", "recoveries", F.greatest(F.col("periods") - 1, F.lit(0)).alias("regressions"), F.col("unresolved").cast("long").alias("unresolved"),
        F.coalesce(F.try_divide(F.col("recoveries").cast("double"), F.col("periods").cast("double")), F.lit(1.0)).alias("recovery_rate"))


def reliability_trend(traj: DataFrame) -> DataFrame:
    """Slope of the score over the run index; DEGRADING under -1.5, IMPROVING over 1.5."""
    p = running_totals(traj.withColumn("_one", F.lit(1)), ["lineage_id"], "run_index", ["_one"], bounded_keys=False)
    x = F.col("lt__one").cast("double")
    out = p.groupBy("lineage_id").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.regr_slope("score", x), F.lit(0.0)).alias("slope"),
        F.coalesce(F.when(F.max("score") > F.min("score"), F.regr_r2("score", x)), F.lit(0.0)).alias("r2"))
    few = F.col("n") < 3
    kind = F.when(few, F.lit("INSUFFICIENT_DATA")).when(F.col("slope") < -1.5, F.lit("DEGRADING")).when(F.col("slope") > 1.5, F.lit("IMPROVING")).otherwise(F.lit("STABLE"))
    return out.select("lineage_id", "n", F.when(few, F.lit(0.0)).otherwise(F.col("slope")).alias("slope"), F.when(few, F.lit(0.0)).otherwise(F.col("r2")).alias("r2"), kind.alias("trend"))


def durability_summary(held: DataFrame) -> DataFrame:
    s = F.col("status")
    out = held.groupBy("lineage_id").agg(
        F.count_if(s == "SUSTAINED").alias("sustained"), F.count_if(s == "TEMPORARY").alias("temporary"), F.count_if(s == "FAILED_TO_SUSTAIN").alias("failed"),
        F.count_if(s == "INSUFFICIENT_FOLLOWUP").alias("pending"))
    judged = F.col("sustained") + F.col("temporary") + F.col("failed")
    return out.withColumn("durability_rate", F.try_divide(F.col("sustained").cast("double"), judged.cast("double")))


def incident_counts(incidents: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Active incidents by severity; reopenings from the event log; recurring = at least two reopenings of one incident."""
    active = ~F.col("lifecycle_state").isin("RESOLVED", "SUPPRESSED")
    sev = F.col("severity")
    out = incidents.groupBy("lineage_id").agg(
        F.count_if(active).alias("active_incidents"), F.count_if(active & (sev == "CRITICAL")).alias("critical_incidents"), F.count_if(active & (sev == "HIGH")).alias("high_incidents"))
    source = incidents.select("lineage_id", "fingerprint", F.col("reopen_count").alias("k")) if events is None else events.filter(
        F.col("event") == "REOPEN").groupBy("lineage_id", "fingerprint").agg(F.count(F.lit(1)).alias("k"))
    r = source.groupBy("lineage_id").agg(F.sum("k").alias("reopened_incidents"), F.count_if(F.col("k") >= 2).alias("recurring_incidents"))
    return out.join(r, "lineage_id", "full_outer").fillna(0)


COUNTS = ["active_incidents", "critical_incidents", "high_incidents", "reopened_incidents", "recurring_incidents", "sustained", "temporary", "failed", "regressions", "recoveries", "unresolved"]


def reliability_inputs(traj: DataFrame, incidents: DataFrame, durability: DataFrame) -> DataFrame:
    """One row per lineage with everything the score needs. ``incidents`` from incident_counts, ``durability`` from durability_summary."""
    latest = traj.groupBy("lineage_id").agg(F.max_by("health_state", "run_index").alias("health_state"))
    out = (
        latest.join(recovery_profile(traj), "lineage_id").join(reliability_trend(traj).drop("n"), "lineage_id")
        .join(incidents, "lineage_id", "left").join(durability, "lineage_id", "left")
    )
    return out.fillna(0, COUNTS)


def score_items() -> list[tuple[str, Column]]:
    """Named contributions to the score; points are fixed values."""
    c = F.col
    cap = lambda name, each, most: F.least(c(name) * each, F.lit(most))
    return [
        ("health", F.when(c("health_state") == "CRITICAL", -25).when(c("health_state") == "DEGRADED", -12).otherwise(0)),
        ("critical_incidents", -cap("critical_incidents", 25, 50)),
        ("high_incidents", -cap("high_incidents", 8, 20)),
        ("reopened_incidents", -cap("reopened_incidents", 6, 18)),
        ("recurring_incidents", -cap("recurring_incidents", 4, 12)),
        ("failed_remediations", -cap("failed", 8, 15)),
        ("temporary_remediations", -cap("temporary", 6, 12)),
        ("regressions", -cap("regressions", 8, 16)),
        ("degrading_trend", F.when(c("trend") == "DEGRADING", -10).otherwise(0)),
        ("clean_history", F.when((c("runs") >= 5) & (c("active_incidents") == 0), 5).otherwise(0)),
        ("sustained_remediations", cap("sustained", 5, 10)),
        ("recovered", F.when((c("recoveries") > 0) & (c("unresolved") == 0), 5).otherwise(0)),
    ]


def reliability_score(inputs: DataFrame) -> DataFrame:
    """Add score (0 to 100), total deductions and total bonuses."""
    points = [p for _, p in score_items()]
    down = sum((F.least(p, F.lit(0)) for p in points), F.lit(0))
    up = sum((F.greatest(p, F.lit(0)) for p in points), F.lit(0))
    return inputs.withColumns({
        "deductions": (-down).cast("long"), "bonuses": up.cast("long"), "score": F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) + down + up)).cast("long")})


def score_breakdown(inputs: DataFrame) -> DataFrame:
    cells = [F.struct(F.lit(n).alias("item"), p.cast("long").alias("points")) for n, p in score_items()]
    return inputs.select("lineage_id", F.inline(F.filter(F.array(*cells), lambda i: i["points"] != 0)))


def reliability_state(scored: DataFrame) -> DataFrame:
    """State ladder, grade, confidence by run count and governance recommendation."""
    c = F.col
    s, h, t = c("score"), c("health_state"), c("trend")
    crit, active, reopened = c("critical_incidents"), c("active_incidents"), c("reopened_incidents")
    recovered = (c("recoveries") > 0) & (c("unresolved") == 0)
    state = (
        F.when((h == "CRITICAL") | (crit >= 1) | (s < 50), F.lit("CRITICAL"))
        .when(((t == "DEGRADING") & (s < 75)) | (reopened >= 2) | (s < 65), F.lit("AT_RISK"))
        .when((h == "DEGRADED") | (active > 0) | (s < 78), F.lit("DEGRADED"))
        .when((h == "RECOVERING") | (recovered & (s < 90)), F.lit("RECOVERING"))
        .when(s >= 80, F.lit("HEALTHY"))
        .otherwise(F.lit("STABLE"))
    )
    r = c("reliability_state")
    grade = F.when(r == "CRITICAL", F.lit("F")).when(s >= 90, F.lit("A")).when(s >= 80, F.lit("B")).when(s >= 70, F.lit("C")).when(s >= 60, F.lit("D")).otherwise(F.lit("F"))
    sure = F.when(c("runs") >= 8, F.lit("HIGH")).when(c("runs") >= 4, F.lit("MEDIUM")).when(c("runs") >= 2, F.lit("LOW")).otherwise(F.lit("INSUFFICIENT"))
    advice = (
        F.when(c("confidence") == "INSUFFICIENT", F.lit("INSUFFICIENT_EVIDENCE"))
        .when((r == "CRITICAL") | ((crit > 0) & (t == "DEGRADING")) | (s < 45), F.lit("ESCALATE"))
        .when((r == "AT_RISK") | (crit > 0) | ((active >= 2) & (t == "DEGRADING")), F.lit("PRIORITY_REVIEW"))
        .when((r == "DEGRADED") | (t == "DEGRADING") | (reopened >= 2), F.lit("REVIEW_REQUIRED"))
        .when(r.isin("STABLE", "RECOVERING") | (active > 0), F.lit("MONITOR"))
        .otherwise(F.lit("NORMAL_OPERATION"))
    )
    reason = F.format_string("score %d, state %s, %d critical incidents, trend %s", s, r, crit, t)
    return scored.withColumn("reliability_state", state).withColumn("grade", grade).withColumn("confidence", sure).withColumn(
        "recommendation", advice).withColumn("reason", reason)


def reliability_factors(profiles: DataFrame) -> DataFrame:
    """Risk and strength rows per lineage."""
    c = F.col
    row = lambda when, kind, name, v: F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("factor"), v.cast("double").alias("value")))
    cells = F.array(
        row(c("critical_incidents") > 0, "RISK", "critical_incidents", c("critical_incidents")),
        row(c("trend") == "DEGRADING", "RISK", "degrading_trend", c("slope")),
        row(c("reopened_incidents") > 0, "RISK", "reopened_incidents", c("reopened_incidents")),
        row((c("temporary") > 0) | (c("failed") > 0), "RISK", "weak_remediations", c("temporary") + c("failed")),
        row(c("regressions") > 0, "RISK", "regressions", c("regressions")),
        row((c("score") >= 80) & (c("active_incidents") == 0), "STRENGTH", "clean_operation", c("score")),
        row(c("sustained") > 0, "STRENGTH", "sustained_remediations", c("sustained")),
        row((c("recoveries") > 0) & (c("unresolved") == 0), "STRENGTH", "full_recovery", c("recoveries")),
        row(c("trend") == "IMPROVING", "STRENGTH", "improving_trend", c("slope")),
    )
    return profiles.select("lineage_id", F.inline(F.filter(cells, lambda x: x.isNotNull())))


def last_runs_by_health(traj: DataFrame) -> DataFrame:
    last = lambda s: F.max_by("run_id", F.when(F.col("health_state") == s, F.col("run_index"))).alias(f"last_{s.lower()}_run")
    return traj.groupBy("lineage_id").agg(last("HEALTHY"), last("DEGRADED"), last("CRITICAL"))


def governance_events(existing: DataFrame, proposed: DataFrame) -> DataFrame:
    """Append only events whose (lineage, type, source) is new."""
    keys = ["lineage_id", "event_type", "source_type", "source_id"]
    return proposed.dropDuplicates(keys).join(existing, keys, "left_anti")


def profile_events(profiles: DataFrame) -> DataFrame:
    """Events a profile gives rise to: its state and its recommendation."""
    row = lambda t, source, i: F.struct(F.lit(t).alias("event_type"), F.lit(source).alias("source_type"), i.alias("source_id"))
    return profiles.select("lineage_id", F.inline(F.array(
        row("RELIABILITY_STATE", "PROFILE", F.col("reliability_state")), row("RECOMMENDATION", "PROFILE", F.col("recommendation")))))


STATES = ["CRITICAL", "AT_RISK", "DEGRADED", "RECOVERING", "STABLE", "HEALTHY", "UNKNOWN"]
TRENDS = ["DEGRADING", "VOLATILE", "INSUFFICIENT_DATA", "STABLE", "IMPROVING"]


def fleet_overview(profiles: DataFrame) -> DataFrame:
    r = F.col("reliability_state")
    return profiles.agg(
        F.count(F.lit(1)).alias("lineages"), F.avg("score").alias("mean_score"), *[F.count_if(r == s).alias(s.lower()) for s in STATES],
        F.count_if(F.col("trend") == "DEGRADING").alias("degrading"), F.sum("active_incidents").alias("active_incidents"))


def _order(c: Column, names: Sequence[str]) -> Column:
    at = F.array_position(F.array(*[F.lit(n) for n in names]), c)
    return F.when(at > 0, at).otherwise(F.lit(10))


def fleet_ranking(profiles: DataFrame) -> DataFrame:
    """Lineages from the riskiest on, with tier and reasons. The rank comes from running totals, not from one global sort."""
    c = F.col
    key = F.struct(
        _order(c("reliability_state"), STATES).alias("a"), (-c("critical_incidents")).alias("b"), _order(c("trend"), TRENDS).alias("c"),
        (-c("reopened_incidents")).alias("d"), c("score").alias("e"), c("lineage_id").alias("f"))
    tier = (
        F.when((c("reliability_state") == "CRITICAL") | (c("health_state") == "CRITICAL") | (c("critical_incidents") > 0) | (c("score") < 50), F.lit("CRITICAL"))
        .when((c("reliability_state") == "AT_RISK") | (c("score") < 65), F.lit("HIGH"))
        .when((c("reliability_state") == "DEGRADED") | (c("trend") == "DEGRADING") | (c("score") < 78), F.lit("MEDIUM")).otherwise(F.lit("LOW"))
    )
    said = lambda when, text: F.when(when, F.lit(text))
    reasons = F.concat_ws(", ", said(c("critical_incidents") > 0, "critical incidents"), said(c("trend") == "DEGRADING", "degrading"),
                          said(c("reopened_incidents") > 0, "reopenings"), said(c("failed") > 0, "failed remediations"), said(c("regressions") > 0, "regressions"))
    rows = profiles.withColumns({"_key": key, "_all": F.substring(c("lineage_id"), 1, 0), "_one": F.lit(1)})
    ranked = running_totals(rows, ["_all"], "_key", ["_one"])
    return ranked.select((c("lt__one") + 1).alias("rank"), "lineage_id", "reliability_state", "score", "trend", tier.alias("tier"),
                         F.when(reasons == "", F.lit("status only")).otherwise(reasons).alias("reasons"))


def risk_matrix(profiles: DataFrame) -> DataFrame:
    """Health x trend: nine fixed cells with count and risk level; other states count as healthy or stable."""
    cells = profiles.sparkSession.createDataFrame(RISK_LEVELS, "health string, trend string, risk string")
    counts = _risk_cells(profiles).groupBy("health", "trend").agg(F.count(F.lit(1)).alias("lineages"))
    return cells.join(counts, ["health", "trend"], "left").fillna(0, ["lineages"])


def risk_matrix_lineages(profiles: DataFrame) -> DataFrame:
    """Every lineage with its cell of the risk matrix and the cell's risk level."""
    cells = profiles.sparkSession.createDataFrame(RISK_LEVELS, "health string, trend string, risk string")
    return _risk_cells(profiles).join(F.broadcast(cells), ["health", "trend"])


# Risk level of each cell.
RISK_LEVELS = [
    ("HEALTHY", "IMPROVING", "LOW"), ("HEALTHY", "STABLE", "LOW"), ("HEALTHY", "DEGRADING", "MEDIUM"),
    ("DEGRADED", "IMPROVING", "LOW"), ("DEGRADED", "STABLE", "MEDIUM"), ("DEGRADED", "DEGRADING", "HIGH"),
    ("CRITICAL", "IMPROVING", "MEDIUM"), ("CRITICAL", "STABLE", "HIGH"), ("CRITICAL", "DEGRADING", "CRITICAL"),
]


def _risk_cells(profiles: DataFrame) -> DataFrame:
    h = F.when(F.col("health_state").isin("HEALTHY", "DEGRADED", "CRITICAL"), F.col("health_state")).otherwise(F.lit("HEALTHY"))
    t = F.when(F.col("trend").isin("IMPROVING", "STABLE", "DEGRADING"), F.col("trend")).otherwise(F.lit("STABLE"))
    return profiles.select(h.alias("health"), t.alias("trend"), "lineage_id")


def fleet_patterns(profiles: DataFrame, drifting: DataFrame | None = None) -> DataFrame:
    """Patterns seen in at least two lineages. ``drifting``: lineages with drift evidence."""
    c = F.col
    said = lambda when, text: F.when(when, F.lit(text))
    marks = F.array(said(c("reopened_incidents") > 0, "INCIDENT_REOPENING"), said((c("failed") > 0) | (c("temporary") > 0), "REMEDIATION_FAILURE"),
                    said(c("trend") == "DEGRADING", "DEGRADING_RELIABILITY"))
    rows = profiles.select("lineage_id", F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("pattern"))
    if drifting is not None:
        rows = rows.unionByName(drifting.select("lineage_id", F.lit("RECURRING_DRIFT").alias("pattern")))
    return rows.groupBy("pattern").agg(F.count_distinct("lineage_id").alias("lineages")).filter(F.col("lineages") >= 2)


def compare_lineages(profiles: DataFrame, a: str, b: str) -> DataFrame:
    """metric, value of a, value of b, difference."""
    names = ["score", "slope", *COUNTS, "recovery_rate"]
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v")) for n in names])
    rows = profiles.filter(F.col("lineage_id").isin(a, b)).select("lineage_id", F.inline(cells))
    side = lambda k: F.max(F.when(F.col("lineage_id") == k, F.col("v")))
    out = rows.groupBy("metric").agg(side(a).alias("first"), side(b).alias("second"))
    return out.withColumn("difference", F.col("second") - F.col("first"))
