"""Monitoring of all lineages at once: observations to alerts, incidents and reliability."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import incidents as I
from ..operators import monitoring as M
from ..operators import temporal as T
from ..session import cut_lineage


@dataclass
class Watch:
    tracks: DataFrame
    change_points: DataFrame
    alerts: DataFrame
    alert_events: DataFrame
    dimensions: DataFrame
    decision: DataFrame


def watch(norm: DataFrame, runs: DataFrame, state: DataFrame, run_id: Column, now: Column, experiments: DataFrame | None = None,
          previous: DataFrame | None = None, policies: DataFrame | None = None) -> Watch:
    """Recompute the monitoring of every lineage. Stages read more than once are stored first."""
    operational = M.operational_runs(runs)
    obs = cut_lineage(T.extract_observations(norm, operational))
    tracks, points = cut_lineage(T.issue_tracks(obs)), cut_lineage(T.change_point(obs))
    held = None if experiments is None else T.durability(experiments, obs, T.run_index(operational))
    alerts, events = M.sync_alerts(state, T.temporal_alerts(tracks, points, held), run_id, now)
    alerts = cut_lineage(alerts)
    latest = obs.groupBy("lineage_id").agg(F.max("run_index").alias("run_index"))
    current = obs.join(latest, ["lineage_id", "run_index"]).select("lineage_id", "module", "metric_name", "target_key", "metric_value", "severity")
    worst = current.groupBy("lineage_id", "module", "metric_name", "target_key").agg(
        T.name4(F.max(T.rank4(F.col("severity")))).alias("severity"))
    trends = T.trend(obs).join(worst, ["lineage_id", "module", "metric_name", "target_key"], "left")
    dims = M.health_dimensions(current, ["lineage_id"], M.temporal_evidence(trends, tracks, held))
    counts = operational.groupBy("lineage_id").agg(F.count(F.lit(1)).alias("baseline_runs"))
    return Watch(tracks, points, alerts, events, dims, M.health_decision(dims, counts, alerts, previous, policies))


def incidents_of(alerts: DataFrame, decision: DataFrame) -> DataFrame:
    """Open incidents of an alert state with priority."""
    active = alerts.filter(~F.col("lifecycle_state").isin("RESOLVED", "SUPPRESSED")).select(
        F.col("alert_fingerprint").alias("alert_id"), "lineage_id", "target_key", F.lit(None).cast("string").alias("investigation"),
        F.lit(None).cast("string").alias("track"), F.col("first_seen_run_id").alias("first_run"), "source_module", "metric_name",
        F.col("last_seen_run_id").alias("last_run"), F.col("current_severity").alias("severity"), "consecutive_count", "severity_change")
    return I.incident_priority(I.incident_identity(active, I.incident_clusters(active)), decision)
