"""Incidents: clusters of related alerts, their priority and the next step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.components import components
from ..session import cut_lineage
from .lifecycle import INCIDENT_TRANSITIONS, apply_actions
from .temporal import name4, rank4


def _same(a: str, b: str) -> Column:
    x, y = F.lower(F.trim(F.col(a))), F.lower(F.trim(F.col(b)))
    return F.coalesce((x == y) & (x != ""), F.lit(False))


def pair_score(a: str = "a", b: str = "b") -> Column:
    """Correlation score of two alert structs: same target 35, investigation 25, track 20, first run 20,
    module 10, metric 10, subgroup 15, last run 10; at most 100."""
    key = lambda side: F.coalesce(F.lower(F.trim(F.col(f"{side}.target_key"))), F.lit("global"))
    same_target = (key(a) != "global") & (key(a) == key(b))
    points = lambda c, n: F.when(c, n).otherwise(0)
    total = (
        points(same_target, 35) + points(_same(f"{a}.investigation", f"{b}.investigation"), 25) + points(_same(f"{a}.track", f"{b}.track"), 20)
        + points(_same(f"{a}.first_run", f"{b}.first_run"), 20) + points(_same(f"{a}.source_module", f"{b}.source_module"), 10)
        + points(_same(f"{a}.metric_name", f"{b}.metric_name"), 10) + points(same_target & key(a).startswith("subgroup::"), 15)
        + points(_same(f"{a}.last_run", f"{b}.last_run"), 10)
    )
    return F.least(total, F.lit(100))


def hub_cells() -> Column:
    """The hubs of an alert row: array of ``hub``, ``context`` (ties only with a GLOBAL alert) and ``anchor`` (this alert is one)."""
    specific = F.lower(F.trim(F.coalesce("target_key", F.lit("global"))))
    is_global = specific == "global"
    full = [F.col("first_run"), F.col("source_module"), F.col("metric_name"), F.col("last_run")]
    present = full[0].isNotNull() & full[1].isNotNull() & full[2].isNotNull() & full[3].isNotNull()

    def hub(tag: str, *cs: Column) -> Column:
        name = F.concat_ws("|", F.lit(tag), F.col("lineage_id"), *[F.lower(c.cast("string")) for c in cs])
        return F.struct(name.alias("hub"), F.lit(tag == "context").alias("context"), is_global.alias("anchor"))

    cells = F.array(
        F.when(~is_global, hub("target", specific)),
        F.when(F.coalesce(F.trim("investigation") != "", F.lit(False)), hub("investigation", F.col("investigation"))),
        F.when(F.col("track").isNotNull(), hub("track", F.col("track"))),
        F.when(present, hub("context", *full)),
    )
    return F.array_compact(cells)


def alert_links(alerts: DataFrame) -> DataFrame:
    """alert_id, hub: alerts that share a hub are related, so no pairs are formed.

    Hubs are the target, the investigation and the issue track. Without those a
    pair reaches 50 points only if first run, module, metric and last run all
    agree; two different specific targets never relate that way, so this hub
    counts only where a GLOBAL alert takes part, which then ties all its members.
    """
    links = alerts.select("alert_id", F.explode(hub_cells()).alias("c")).select("alert_id", "c.hub", "c.context", "c.anchor")
    anchored = links.filter("context").groupBy("hub").agg(F.bool_or("anchor").alias("_ok")).filter("_ok").select("hub")
    plain = links.filter(~F.col("context")).select("alert_id", "hub")
    return plain.unionByName(links.filter("context").join(anchored, "hub", "left_semi").select("alert_id", "hub"))


def hub_scores(alerts: DataFrame) -> DataFrame:
    """Every related alert with the score against the smallest alert of its hub: the evidence list, linear in the alerts."""
    body = F.struct("alert_id", "target_key", "investigation", "track", "first_run", "source_module", "metric_name", "last_run")
    links = alert_links(alerts).join(alerts.select("alert_id", body.alias("b")), "alert_id")
    heads = links.groupBy("hub").agg(F.min_by("b", "alert_id").alias("a"))
    return links.join(heads, "hub").filter(F.col("a.alert_id") != F.col("alert_id")).select(
        "hub", F.col("a.alert_id").alias("head_id"), "alert_id", pair_score().alias("score"))


def incident_clusters(alerts: DataFrame) -> DataFrame:
    """alert_id, incident_key: connected components over shared hubs, labelled by the smallest alert id.

    Alerts are numbered, every hub is replaced by links to its least number, and
    components are found on these numbers only.
    """
    ids = cut_lineage(alerts.select("alert_id").distinct().withColumn("id", F.monotonically_increasing_id()))
    members = cut_lineage(alert_links(alerts).join(ids, "alert_id").select("hub", "id"))
    heads = cut_lineage(members.groupBy("hub").agg(F.min("id").alias("head")))
    pairs = members.join(heads, "hub").select(F.col("id").alias("a"), F.col("head").alias("b"))
    found = cut_lineage(components(pairs))
    rooted = cut_lineage(ids.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")))
    names = cut_lineage(rooted.groupBy("root").agg(F.min("alert_id").alias("incident_key")))
    return rooted.join(names, "root").select("alert_id", "incident_key")


def incident_identity(alerts: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row per incident: severity, primary target, category, fingerprint, code and title."""
    rows = alerts.join(clusters, "alert_id")
    specific = F.upper(F.coalesce("target_key", F.lit("GLOBAL"))) != "GLOBAL"
    primary = F.min_by("target_key", F.when(specific, F.struct((-rank4(F.col("severity"))).alias("r"), F.col("target_key"))))
    out = rows.groupBy("incident_key").agg(
        F.min("lineage_id").alias("lineage_id"), F.count(F.lit(1)).alias("alerts"), F.max(rank4(F.col("severity"))).alias("_rank"),
        F.coalesce(primary, F.lit("GLOBAL")).alias("primary_target"),
        F.array_sort(F.collect_set(F.upper("source_module"))).alias("modules"),
        F.max("consecutive_count").alias("max_consecutive"), F.bool_or(F.col("severity_change") == "ESCALATED").alias("escalating"))
    only = F.when(F.size("modules") == 1, F.get("modules", F.lit(0)))
    category = (
        F.when(only == "DRIFT", F.lit("DRIFT_INCIDENT")).when(only.isin("ERROR_FORENSICS", "ERROR"), F.lit("ERROR_INCIDENT"))
        .when(only == "DATA_QUALITY", F.lit("DATA_QUALITY_INCIDENT")).when(only == "LEAKAGE", F.lit("LEAKAGE_INCIDENT"))
        .when(only == "PERFORMANCE", F.lit("PERFORMANCE_INCIDENT")).when(only == "CALIBRATION", F.lit("CALIBRATION_INCIDENT"))
        .when(only.isin("FAIRNESS", "BIAS"), F.lit("FAIRNESS_INCIDENT")).when(only == "ROBUSTNESS", F.lit("ROBUSTNESS_INCIDENT"))
        .when(only == "TEMPORAL", F.lit("TEMPORAL_DEGRADATION")).otherwise(F.lit("MULTI_MODULE_INCIDENT"))
    )
    named = out.withColumn("severity", name4(F.col("_rank"))).withColumn("category", category).drop("_rank")
    print_ = F.sha2(F.concat_ws("::", "lineage_id", "primary_target", "category"), 256)
    title = F.format_string("[%s] %s on %s (%s)", "severity", F.initcap(F.lower(F.replace("category", F.lit("_"), F.lit(" ")))), "primary_target", F.concat_ws(" + ", "modules"))
    return named.withColumn("fingerprint", print_).withColumn("code", F.concat(F.lit("INC-"), F.upper(F.substring("fingerprint", 1, 4)))).withColumn("title", title)


def incident_priority(incidents: DataFrame, health: DataFrame) -> DataFrame:
    """Severity 40/25/15/5 + 10 per module up to 40 + persistence up to 15 + health 10/5. ``health``: lineage_id, health_state."""
    j = incidents.join(health.select("lineage_id", "health_state"), "lineage_id", "left")
    sev = F.when(F.col("severity") == "CRITICAL", 40).when(F.col("severity") == "HIGH", 25).when(F.col("severity").isin("MEDIUM", "WARNING"), 15).otherwise(5)
    mods = F.least(F.lit(40), F.greatest(F.size("modules"), F.lit(1)) * 10)
    keep = F.least(F.lit(15), F.when(F.col("escalating"), 10).otherwise(0) + F.when(F.col("max_consecutive") >= 2, 5).otherwise(0))
    ill = F.when(F.col("health_state") == "CRITICAL", 10).when(F.col("health_state") == "DEGRADED", 5).otherwise(0)
    total = F.least(F.lit(100), sev + mods + keep + ill)
    tier = F.when(total >= 85, F.lit("CRITICAL")).when(total >= 65, F.lit("HIGH")).when(total >= 45, F.lit("MEDIUM")).when(total >= 25, F.lit("LOW")).otherwise(F.lit("INFO"))
    return j.withColumn("priority_score", total.cast("long")).withColumn("priority", tier)


def contradictions(incidents: DataFrame, dims: DataFrame) -> DataFrame:
    """Drift without harm, or errors with clean inputs. ``dims``: lineage_id, dimension, state."""
    state = lambda d: F.max(F.when(F.col("dimension") == d, F.col("state")))
    h = dims.groupBy("lineage_id").agg(state("PERFORMANCE").alias("_perf"), state("DATA_QUALITY").alias("_quality"))
    drift, error = F.array_contains("modules", "DRIFT"), F.array_contains("modules", "ERROR_FORENSICS")
    harmless = drift & (F.col("_perf") == "HEALTHY") & ~F.array_contains("modules", "PERFORMANCE")
    unexplained = error & (F.col("_quality") == "HEALTHY") & ~drift
    false = F.lit(False)
    return incidents.join(h, "lineage_id", "left").withColumn("harmless_drift", F.coalesce(harmless, false)).withColumn(
        "unexplained_errors", F.coalesce(unexplained, false)).withColumn("contradictory", F.col("harmless_drift") | F.col("unexplained_errors")).drop("_perf", "_quality")


def incident_decision(df: DataFrame) -> DataFrame:
    """Next step and confidence. Needs contradictory, has_investigation, has_remediation, has_validated, reopened,
    priority_score, modules, alerts."""
    c, inv, rem, val = (F.col(x) for x in ("contradictory", "has_investigation", "has_remediation", "has_validated"))
    n = F.size("modules")
    decision = (
        F.when(c & ~rem & ~val, F.lit("MONITOR")).when(F.col("reopened"), F.lit("REOPEN_INVESTIGATION"))
        .when((F.col("priority_score") >= 85) & (n >= 3) & ~rem, F.lit("ESCALATE")).when(val, F.lit("MONITOR"))
        .when(rem, F.lit("VALIDATE_REMEDIATION")).when(inv, F.lit("REVIEW_REMEDIATION")).when(F.col("alerts") > 0, F.lit("INVESTIGATE")).otherwise(F.lit("NO_ACTION"))
    )
    high = ~c & ((F.col("decision") != "INVESTIGATE") | (n >= 2))
    return df.withColumn("decision", decision).withColumn("decision_confidence", F.when(high, F.lit("HIGH")).otherwise(F.lit("MEDIUM")))


def evidence_matrix(alerts: DataFrame, clusters: DataFrame) -> DataFrame:
    """Incident x module: alerts, worst severity, metrics."""
    return alerts.join(clusters, "alert_id").groupBy("incident_key", "source_module").agg(
        F.count(F.lit(1)).alias("alerts"), name4(F.max(rank4(F.col("severity")))).alias("worst_severity"),
        F.concat_ws(",", F.array_sort(F.collect_set("metric_name"))).alias("metrics"))


def act_on_incidents(incidents: DataFrame, actions: DataFrame) -> DataFrame:
    return apply_actions(incidents, actions, "fingerprint", INCIDENT_TRANSITIONS)


def sync_incidents(state: DataFrame, current: DataFrame) -> DataFrame:
    """Merge known incidents with the clusters of this recompute.

    New fingerprints open, resolved ones that reappear reopen, absent ones keep
    their state. ``state``: fingerprint, lifecycle_state, reopen_count.
    """
    o = state.select("fingerprint", F.col("lifecycle_state").alias("_old"), F.col("reopen_count").alias("_reopens"))
    # Two clusters may share a fingerprint; the larger speaks for it.
    n = current.groupBy("fingerprint").agg(
        F.max_by(F.struct("lineage_id", "code", "severity", "primary_target", "category"), F.struct("alerts", "incident_key")).alias("n"), F.sum("alerts").alias("alerts"))
    both = o.join(n, "fingerprint", "full_outer")
    seen, known = F.col("n").isNotNull(), F.col("_old").isNotNull()
    back = known & seen & (F.col("_old") == "RESOLVED")
    life = F.when(~known, F.lit("OPEN")).when(back, F.lit("REOPENED")).otherwise(F.col("_old"))
    return both.select(
        "fingerprint", "n.lineage_id", "n.code", "n.severity", "n.primary_target", "n.category", F.coalesce("alerts", F.lit(0)).alias("alerts"),
        life.alias("lifecycle_state"), (F.coalesce("_reopens", F.lit(0)) + F.coalesce(back.cast("int"), F.lit(0))).cast("long").alias("reopen_count"),
        F.when(~known, F.lit("CREATED")).when(back, F.lit("REOPENED")).when(seen, F.lit("UPDATED")).otherwise(F.lit("ABSENT")).alias("change"))


def incident_dossier(incidents: DataFrame, alerts: DataFrame, clusters: DataFrame, related: DataFrame, fingerprint: str) -> DataFrame:
    """One incident with its alerts and what is linked to their targets (lineage_id, target_key, kind, id)."""
    mine = incidents.filter(F.col("fingerprint") == fingerprint)
    members = alerts.join(clusters, "alert_id").join(mine.select("incident_key", "fingerprint", "code", "title"), "incident_key")
    linked = related.groupBy("lineage_id", "target_key").agg(F.concat_ws(",", F.array_sort(F.collect_set("kind"))).alias("linked"))
    return members.join(linked, ["lineage_id", "target_key"], "left").select(
        "fingerprint", "code", "title", "alert_id", "target_key", "metric_name", "source_module", "severity", "linked")


