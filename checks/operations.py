"""Monitoring, incident, reliability and fleet queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import experiments as X
from plumbline.operators import clusters as C
from plumbline.operators import incidents as I
from plumbline.operators import lifecycle as L
from plumbline.operators import monitoring as M
from plumbline.operators import reliability as R
from plumbline.operators import temporal as T
from plumbline.streaming.run import work_folder

from .common import Registry, r6, rounded, stored, table
from .history import ALERTS, OBS, alerts, experiments, observations, runs, tracks
from .results import WIDE
from .rules import norm

# --- alerts from order lines: keys spread over targets, modules and runs -------------------------

ALERT_SQL = """al AS (SELECT 'L' || (o_custkey % 7) AS lineage_id, lpad(o_orderkey::VARCHAR, 12, '0') AS alert_id,
  CASE WHEN o_orderkey % 5 = 0 THEN 'GLOBAL' ELSE 'FEATURE::c' || o_custkey END AS target_key, CASE WHEN o_orderkey % 11 = 0 THEN 'inv' || (o_orderkey % 401) END AS investigation,
  CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey % 307 END AS track, 'r' || (o_orderkey % 97) AS first_run, ['DRIFT', 'ERROR_FORENSICS', 'PERFORMANCE'][(o_orderkey % 3) + 1] AS source_module,
  'm' || (o_orderkey % 9) AS metric_name, 'r' || (o_orderkey % 89) AS last_run, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][(o_orderkey % 4) + 1] AS severity,
  o_orderkey % 4 AS consecutive_count, CASE WHEN o_orderkey % 17 = 0 THEN 'ESCALATED' ELSE 'UNCHANGED' END AS severity_change FROM orders)"""


def order_alerts(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    cat = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    pick = lambda names, i: F.get(F.array(*[F.lit(n) for n in names]), i.cast("int"))
    return o.select(
        cat("L", F.col("o_custkey") % 7).alias("lineage_id"), F.lpad(k.cast("string"), 12, "0").alias("alert_id"),
        F.when(k % 5 == 0, F.lit("GLOBAL")).otherwise(cat("FEATURE::c", F.col("o_custkey"))).alias("target_key"),
        F.when(k % 11 == 0, cat("inv", k % 401)).alias("investigation"), F.when(k % 13 == 0, k % 307).alias("track"), cat("r", k % 97).alias("first_run"),
        pick(["DRIFT", "ERROR_FORENSICS", "PERFORMANCE"], k % 3).alias("source_module"), cat("m", k % 9).alias("metric_name"), cat("r", k % 89).alias("last_run"),
        pick(["LOW", "MEDIUM", "HIGH", "CRITICAL"], k % 4).alias("severity"), (k % 4).alias("consecutive_count"),
        F.when(k % 17 == 0, F.lit("ESCALATED")).otherwise(F.lit("UNCHANGED")).alias("severity_change"))


HUBS = """lk AS (SELECT alert_id, 'target|' || lineage_id || '|' || lower(target_key) AS hub, false AS g FROM al WHERE target_key <> 'GLOBAL'
  UNION ALL SELECT alert_id, 'investigation|' || lineage_id || '|' || investigation, false FROM al WHERE investigation IS NOT NULL
  UNION ALL SELECT alert_id, 'track|' || lineage_id || '|' || track, false FROM al WHERE track IS NOT NULL
  UNION ALL SELECT alert_id, 'context|' || lineage_id || '|' || first_run || '|' || lower(source_module) || '|' || metric_name || '|' || last_run, target_key = 'GLOBAL' FROM al),
links AS (SELECT alert_id, hub FROM lk l WHERE hub NOT LIKE 'context|%' OR EXISTS (SELECT 1 FROM lk o WHERE o.hub = l.hub AND o.g))"""


# Components of alerts and their incidents: every alert takes the smallest label among its neighbours until none changes.
CLUSTERS = f"""{ALERT_SQL}, {HUBS}, heads AS (SELECT hub, min(alert_id) AS head FROM links GROUP BY 1),
near AS (SELECT DISTINCT alert_id AS a, head AS b FROM links JOIN heads USING (hub) UNION SELECT DISTINCT head, alert_id FROM links JOIN heads USING (hub)),
cc(a, root) USING KEY (a) AS (SELECT alert_id, alert_id FROM al UNION
  (SELECT DISTINCT ON (old.a) old.a, cc.root FROM recurring.cc AS old, cc, near WHERE near.a = old.a AND near.b = cc.a AND cc.root < old.root ORDER BY old.a, cc.root)),
cl AS (SELECT a AS alert_id, root AS incident_key FROM cc),
mem AS (SELECT *, CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END AS rk FROM al JOIN cl USING (alert_id)),
inc0 AS (SELECT incident_key, min(lineage_id) AS lineage_id, count(*) AS alerts, max(rk) AS rk,
  coalesce(first(target_key ORDER BY -rk, target_key) FILTER (target_key <> 'GLOBAL'), 'GLOBAL') AS primary_target, count(DISTINCT source_module) AS nm,
  string_agg(DISTINCT source_module, ',' ORDER BY source_module) AS modules, max(consecutive_count) AS max_consecutive, bool_or(severity_change = 'ESCALATED') AS escalating
  FROM mem GROUP BY 1),
inc1 AS (SELECT *, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][rk + 1] AS severity,
  CASE WHEN nm > 1 THEN 'MULTI_MODULE_INCIDENT' WHEN modules = 'DRIFT' THEN 'DRIFT_INCIDENT' WHEN modules = 'ERROR_FORENSICS' THEN 'ERROR_INCIDENT' ELSE 'PERFORMANCE_INCIDENT' END AS category,
  CASE WHEN nm > 1 THEN 'Multi Module Incident' WHEN modules = 'DRIFT' THEN 'Drift Incident' WHEN modules = 'ERROR_FORENSICS' THEN 'Error Incident' ELSE 'Performance Incident' END AS cat_title FROM inc0),
inc AS (SELECT *, sha256(lineage_id || '::' || primary_target || '::' || category) AS fingerprint,
  '[' || severity || '] ' || cat_title || ' on ' || primary_target || ' (' || replace(modules, ',', ' + ') || ')' AS title FROM inc1),
pr AS (SELECT *, least(100, CASE severity WHEN 'CRITICAL' THEN 40 WHEN 'HIGH' THEN 25 WHEN 'MEDIUM' THEN 15 ELSE 5 END + least(40, nm * 10)
  + least(15, CASE WHEN escalating THEN 10 ELSE 0 END + CASE WHEN max_consecutive >= 2 THEN 5 ELSE 0 END) + 5) AS priority_score,
  (nm >= 1 AND contains(modules, 'DRIFT') AND substring(lineage_id, 2)::INT % 2 = 0 AND NOT contains(modules, 'PERFORMANCE'))
  OR (contains(modules, 'ERROR_FORENSICS') AND substring(lineage_id, 2)::INT % 2 = 0 AND NOT contains(modules, 'DRIFT')) AS contradictory FROM inc),
pt AS (SELECT *, CASE WHEN priority_score >= 85 THEN 'CRITICAL' WHEN priority_score >= 65 THEN 'HIGH' WHEN priority_score >= 45 THEN 'MEDIUM' WHEN priority_score >= 25 THEN 'LOW' ELSE 'INFO' END AS priority FROM pr)"""


def clusters(s, d):
    return stored(s, d, "clusters", lambda: I.incident_clusters(order_alerts(s, d)))


def identified(s, d):
    return stored(s, d, "incidents", lambda: I.incident_identity(order_alerts(s, d), clusters(s, d)))


# --- daily snapshots per user bucket ---------------------------------------------------------------

SNAP = """sn AS (SELECT 'L' || (user_id % 20) AS lineage_id, CAST(ts AS DATE) AS d, count(*) AS c, sum(user_id) AS u FROM events GROUP BY ALL),
sx AS (SELECT *, (row_number() OVER (PARTITION BY lineage_id ORDER BY d) - 1)::INT AS run_index, (40 + (u * 7 + c) % 61)::BIGINT AS health_index,
  ['HEALTHY', 'HEALTHY', 'RECOVERING', 'DEGRADED', 'CRITICAL', 'HEALTHY', 'DEGRADED'][((u + c) % 7 + 1)::INT] AS health_state FROM sn)"""


def snapshots(s, d):
    e = table(s, d, "events").groupBy(F.concat(F.lit("L"), (F.col("user_id") % 20).cast("string")).alias("lineage_id"), F.to_date("ts").alias("d")).agg(
        F.count(F.lit(1)).alias("c"), F.sum("user_id").alias("u"))
    r = T.run_index(e.withColumns({"run_id": F.concat_ws(":", "lineage_id", F.col("d").cast("string")), "created_at": F.col("d").cast("timestamp")}))
    names = F.array(*[F.lit(n) for n in ("HEALTHY", "HEALTHY", "RECOVERING", "DEGRADED", "CRITICAL", "HEALTHY", "DEGRADED")])
    return r.select("lineage_id", "run_id", "run_index", F.get(names, ((F.col("u") + F.col("c")) % 7).cast("int")).alias("health_state"),
                    (F.lit(40) + (F.col("u") * 7 + F.col("c")) % 61).alias("health_index"))


TRAJ = f"""WITH RECURSIVE {SNAP}, tj AS (SELECT lineage_id, run_index, health_state, health_index, CASE health_state WHEN 'CRITICAL' THEN greatest(30, least(80, health_index))
  WHEN 'DEGRADED' THEN greatest(50, least(87, health_index)) WHEN 'RECOVERING' THEN least(85, 101) ELSE least(100, 99) END::DOUBLE AS score FROM sx WHERE run_index = 0
  UNION ALL SELECT x.lineage_id, x.run_index, x.health_state, x.health_index, CASE x.health_state WHEN 'CRITICAL' THEN greatest(30, least(score - 15, x.health_index))
  WHEN 'DEGRADED' THEN greatest(50, least(score - 8, x.health_index)) WHEN 'RECOVERING' THEN least(85, score + 6) ELSE least(100, score + 4) END
  FROM tj JOIN sx x ON x.lineage_id = tj.lineage_id AND x.run_index = tj.run_index + 1)"""


def traj(s, d):
    return stored(s, d, "trajectory", lambda: R.trajectory(snapshots(s, d)))


REC = """ed AS (SELECT lineage_id, run_index, health_state IN ('CRITICAL', 'DEGRADED') AS ill, lag(health_state IN ('CRITICAL', 'DEGRADED'), 1, false) OVER (PARTITION BY lineage_id ORDER BY run_index) AS was FROM tj),
rp AS (SELECT lineage_id, count(*) AS runs, count(*) FILTER (ill AND NOT was) AS periods, count(*) FILTER (NOT ill AND was) AS recoveries, max_by(ill, run_index)::INT::BIGINT AS unresolved FROM ed GROUP BY 1),
rt AS (SELECT lineage_id, count(*) AS n, regr_slope(score, run_index) AS slope, CASE WHEN max(score) > min(score) THEN regr_r2(score, run_index) ELSE 0 END AS r2, max_by(health_state, run_index) AS hs FROM tj GROUP BY 1),
tq AS (SELECT *, CASE WHEN n < 3 THEN 'INSUFFICIENT_DATA' WHEN slope < -1.5 THEN 'DEGRADING' WHEN slope > 1.5 THEN 'IMPROVING' ELSE 'STABLE' END AS trend FROM rt),
ic AS (SELECT 'L' || (user_id % 20) AS lineage_id, count(*) FILTER (event_type = 'error' AND event_id % 97 = 0) AS active, count(*) FILTER (event_type = 'error' AND event_id % 388 = 0) AS crit,
  count(*) FILTER (event_type = 'error' AND event_id % 194 = 0) AS high, count(*) FILTER (event_id % 311 = 0) AS reop, count(*) FILTER (event_id % 733 = 0) AS recur,
  count(*) FILTER (event_id % 411 = 0) AS sus, count(*) FILTER (event_id % 577 = 0) AS tmp, count(*) FILTER (event_id % 619 = 0) AS fail FROM events GROUP BY 1),
inp AS (SELECT rp.*, tq.slope, tq.r2, tq.trend, hs, greatest(periods - 1, 0) AS regr, active, crit, high, reop, recur, sus, tmp, fail FROM rp JOIN tq USING (lineage_id) JOIN ic USING (lineage_id)),
sc AS (SELECT *, CASE hs WHEN 'CRITICAL' THEN 25 WHEN 'DEGRADED' THEN 12 ELSE 0 END + least(50, crit * 25) + least(20, high * 8) + least(18, reop * 6) + least(12, recur * 4) + least(15, fail * 8) + least(12, tmp * 6)
  + least(16, regr * 8) + CASE WHEN trend = 'DEGRADING' THEN 10 ELSE 0 END AS ded, CASE WHEN runs >= 5 AND active = 0 THEN 5 ELSE 0 END + least(10, sus * 5) + CASE WHEN recoveries > 0 AND unresolved = 0 THEN 5 ELSE 0 END AS bon FROM inp),
sd AS (SELECT *, greatest(0, least(100, 100 - ded + bon))::BIGINT AS score FROM sc),
st AS (SELECT *, CASE WHEN hs = 'CRITICAL' OR crit >= 1 OR score < 50 THEN 'CRITICAL' WHEN trend = 'DEGRADING' AND score < 75 OR reop >= 2 OR score < 65 THEN 'AT_RISK'
  WHEN hs = 'DEGRADED' OR active > 0 OR score < 78 THEN 'DEGRADED' WHEN hs = 'RECOVERING' OR (recoveries > 0 AND unresolved = 0 AND score < 90) THEN 'RECOVERING' WHEN score >= 80 THEN 'HEALTHY' ELSE 'STABLE' END AS rs FROM sd),
pf AS (SELECT *, CASE WHEN rs = 'CRITICAL' THEN 'F' WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade,
  CASE WHEN runs >= 8 THEN 'HIGH' WHEN runs >= 4 THEN 'MEDIUM' WHEN runs >= 2 THEN 'LOW' ELSE 'INSUFFICIENT' END AS conf,
  CASE WHEN runs < 2 THEN 'INSUFFICIENT_EVIDENCE' WHEN rs = 'CRITICAL' OR (crit > 0 AND trend = 'DEGRADING') OR score < 45 THEN 'ESCALATE' WHEN rs = 'AT_RISK' OR crit > 0 OR (active >= 2 AND trend = 'DEGRADING') THEN 'PRIORITY_REVIEW'
  WHEN rs = 'DEGRADED' OR trend = 'DEGRADING' OR reop >= 2 THEN 'REVIEW_REQUIRED' WHEN rs IN ('STABLE', 'RECOVERING') OR active > 0 THEN 'MONITOR' ELSE 'NORMAL_OPERATION' END AS rec FROM st)"""


def inputs(s, d):
    e, k = table(s, d, "events"), F.col("event_id")
    err = F.col("event_type") == "error"
    c = e.groupBy(F.concat(F.lit("L"), (F.col("user_id") % 20).cast("string")).alias("lineage_id")).agg(
        F.count_if(err & (k % 97 == 0)).alias("active_incidents"), F.count_if(err & (k % 388 == 0)).alias("critical_incidents"), F.count_if(err & (k % 194 == 0)).alias("high_incidents"),
        F.count_if(k % 311 == 0).alias("reopened_incidents"), F.count_if(k % 733 == 0).alias("recurring_incidents"), F.count_if(k % 411 == 0).alias("sustained"),
        F.count_if(k % 577 == 0).alias("temporary"), F.count_if(k % 619 == 0).alias("failed"))
    inc = c.select("lineage_id", "active_incidents", "critical_incidents", "high_incidents", "reopened_incidents", "recurring_incidents")
    return R.reliability_inputs(traj(s, d), inc, c.select("lineage_id", "sustained", "temporary", "failed"))


def profiles(s, d):
    return stored(s, d, "profiles", lambda: R.reliability_state(R.reliability_score(inputs(s, d))))


def register(r: Registry) -> None:
    # -- health dimensions on the supplier runs
    def metrics(s, d):
        return norm(s, d).filter(F.col("target_type") != "SUBGROUP").select("run_id", "module", "metric_name", "target_key", "metric_value")

    lvl = lambda crit, warn, have="true": f"CASE WHEN NOT ({have}) THEN 'UNKNOWN' WHEN {crit} THEN 'CRITICAL' WHEN {warn} THEN 'DEGRADED' ELSE 'HEALTHY' END"
    dims = f"""{WIDE}, fm AS (SELECT run_id, max(psi) AS psi, max(leak) AS leak, max(nulls) AS nulls, max(outl) AS outl, max(assoc) AS assoc, max(flip) AS flip FROM fw GROUP BY 1),
        j AS (SELECT rn.*, fm.* EXCLUDE run_id, roc_ AS roc FROM rn JOIN fm USING (run_id) JOIN (SELECT run_id, roc_ FROM rl) q USING (run_id)),
        dm AS (SELECT run_id, 'DATA_QUALITY' AS dimension, {lvl('nulls >= 0.2', 'nulls >= 0.05 OR outl >= 0.1')} AS state FROM j
        UNION ALL SELECT run_id, 'LEAKAGE', {lvl('leak >= 0.8', 'leak >= 0.5')} FROM j UNION ALL SELECT run_id, 'DRIFT', {lvl('greatest(psi, max_psi) >= 0.25', 'greatest(psi, max_psi) >= 0.1')} FROM j
        UNION ALL SELECT run_id, 'PERFORMANCE', {lvl('(f1 > 0 AND f1 < 0.6) OR roc < 0.65', '(f1 > 0 AND f1 < 0.75) OR roc < 0.8')} FROM j
        UNION ALL SELECT run_id, 'CALIBRATION', {lvl('ece > 0.15', 'ece > 0.08 OR brier > 0.25')} FROM j UNION ALL SELECT run_id, 'ERROR', {lvl('hce > 0.15 OR assoc >= 0.45', 'hce > 0.05 OR assoc >= 0.25')} FROM j
        UNION ALL SELECT run_id, 'FAIRNESS', {lvl('dir < 0.65 OR dp > 0.3', 'dir < 0.8 OR dp > 0.15', 'has_bias')} FROM j UNION ALL SELECT run_id, 'ROBUSTNESS', {lvl('flip >= 0.2', 'flip >= 0.1', 'has_rob')} FROM j)"""
    health = lambda s, d: M.health_dimensions(metrics(s, d), ["run_id"])
    r.add("mn1_health_dimensions", lambda s, d: health(s, d).drop("evidence"), f"WITH {dims} SELECT run_id, dimension, state FROM dm")
    r.add(
        "mn1_temporal_dimension",
        lambda s, d: M.temporal_evidence(T.trend(observations(s, d)).withColumn("severity", F.lit("HIGH")), tracks(s, d)).groupBy("lineage_id").agg(
            F.count(F.lit(1)).alias("evidence"), F.max("grade").alias("least")),
    )

    def decided(s, d):
        n = F.expr("cast(substring(run_id, 2) as int)")
        dims_ = health(s, d).withColumnRenamed("run_id", "lineage_id")
        ids = metrics(s, d).select("run_id").distinct()
        counts = ids.select(F.col("run_id").alias("lineage_id"), (n % 6).alias("baseline_runs"))
        sev = F.get(F.array(*[F.lit(x) for x in ("CRITICAL", "HIGH", "MEDIUM", "LOW")]), n % 4)
        al = ids.filter(n % 3 == 0).select(F.col("run_id").alias("lineage_id"), sev.alias("current_severity"), F.when(n % 2 == 0, F.lit("OPEN")).otherwise(F.lit("RESOLVED")).alias("lifecycle_state"))
        prev = ids.select(F.col("run_id").alias("lineage_id"), F.when(n % 2 == 0, F.lit("DEGRADED")).otherwise(F.lit("HEALTHY")).alias("previous_state"))
        pol = ids.filter(n % 5 == 0).select(F.col("run_id").alias("lineage_id"), *[(F.lit(1) if k == "min_runs" else F.lit(None)).cast("double" if k == "hysteresis" else "int").alias(k) for k in M.POLICY])
        return M.health_decision(dims_, counts, al, prev, pol)

    dec = f"""{dims}, dc AS (SELECT run_id, substring(run_id, 2)::INT AS n, count(*) FILTER (state = 'CRITICAL') AS c, count(*) FILTER (state = 'DEGRADED') AS g, count(*) FILTER (state = 'UNKNOWN') AS u FROM dm GROUP BY 1),
        dx AS (SELECT *, n % 6 AS br, CASE WHEN n % 5 = 0 THEN 1 ELSE 3 END AS mr, (n % 3 = 0 AND n % 2 = 0 AND n % 4 = 0)::INT::BIGINT AS ca, (n % 3 = 0 AND n % 2 = 0 AND n % 4 = 1)::INT::BIGINT AS ha,
        (n % 3 = 0 AND n % 2 = 0 AND n % 4 = 2)::INT::BIGINT AS ma FROM dc)"""
    r.add(
        "mn2_health_decision",
        decided,
        f"""WITH {dec} SELECT run_id AS lineage_id, br AS baseline_runs, c AS critical_dims, g AS degraded_dims, 0::BIGINT AS warning_dims, u AS unknown_dims, ca AS critical_alerts, ha AS high_alerts, ma AS medium_alerts,
        CASE WHEN br < mr THEN 60 ELSE greatest(0, 100 - c * 25 - g * 15 - u * 10 - ca * 10 - ha * 5 - ma * 2) END::BIGINT AS health_index,
        CASE WHEN br < mr OR u >= 3 THEN 'UNKNOWN' WHEN ca > 0 OR c > 0 THEN 'CRITICAL' WHEN ha > 0 OR g > 0 THEN 'DEGRADED' WHEN n % 2 = 0 THEN 'RECOVERING' ELSE 'HEALTHY' END AS health_state FROM dx""",
    )
    r.add(
        "mn6_policy_defaults",
        lambda s, d: rounded(M.with_policy(runs(s, d).select("lineage_id").distinct(), runs(s, d).select("lineage_id").distinct().filter("lineage_id = 'view'").select(
            "lineage_id", F.lit(7).alias("min_runs"), *[F.lit(None).cast("double" if k == "hysteresis" else "int").alias(k) for k in M.POLICY if k != "min_runs"]))),
        """SELECT DISTINCT event_type AS lineage_id, CASE WHEN event_type = 'view' THEN 7 ELSE 3 END::BIGINT AS min_runs, 2::BIGINT AS persistence_runs, 2::BIGINT AS recovery_runs, 1::BIGINT AS cooldown_runs,
        0.05::DOUBLE AS hysteresis FROM events""",
    )
    r.add(
        "mn5_health_snapshots",
        lambda s, d: M.health_snapshots(decided(s, d), F.concat(F.lit("run-"), F.col("lineage_id"))),
        f"""WITH {dec} SELECT run_id AS lineage_id, 'run-' || run_id AS run_id, CASE WHEN br < mr OR u >= 3 THEN 'UNKNOWN' WHEN ca > 0 OR c > 0 THEN 'CRITICAL' WHEN ha > 0 OR g > 0 THEN 'DEGRADED' WHEN n % 2 = 0 THEN 'RECOVERING'
        ELSE 'HEALTHY' END AS health_state, CASE WHEN br < mr THEN 60 ELSE greatest(0, 100 - c * 25 - g * 15 - u * 10 - ca * 10 - ha * 5 - ma * 2) END::BIGINT AS health_index, c AS critical_dims, g AS degraded_dims, u AS unknown_dims,
        ca + ha + ma AS active_alerts FROM dx""",
    )

    # -- two synchronisations: the second run misses some alerts, changes some severities and adds others
    def synced(s, d):
        a = alerts(s, d).withColumn("_h", F.length("target_key") + F.length("metric_name") + F.length("alert_type"))
        first = a.filter(F.col("_h") % 3 != 0)
        second = a.filter(F.col("_h") % 4 != 0).withColumn("priority", F.when(F.col("_h") % 5 == 0, F.lit("CRITICAL")).when(F.col("_h") % 5 == 1, F.lit("LOW")).otherwise(F.col("priority")))
        t1, t2 = (F.lit(t).cast("timestamp") for t in ("2024-02-01 00:00:00", "2024-02-02 00:00:00"))
        state, _ = M.sync_alerts(M.empty_state(s), first, F.lit("run1"), t1)
        return M.sync_alerts(state, second, F.lit("run2"), t2)

    two = f"""{ALERTS}, ah AS (SELECT *, length(target_key) + length(metric_name) + length(alert_type) AS h, lineage_id || '::' || alert_type || '::' || target_type || '::' || target_key || '::' || metric_name AS fp FROM al),
        rk(sev, k) AS (VALUES ('CRITICAL', 3), ('HIGH', 2), ('MEDIUM', 1), ('LOW', 0)),
        a1 AS (SELECT fp, max(k) AS k1 FROM ah JOIN rk ON rk.sev = priority WHERE h % 3 <> 0 GROUP BY 1),
        a2 AS (SELECT fp, max(k) AS k2 FROM (SELECT *, CASE WHEN h % 5 = 0 THEN 'CRITICAL' WHEN h % 5 = 1 THEN 'LOW' ELSE priority END AS p2 FROM ah) z JOIN rk ON rk.sev = p2 WHERE h % 4 <> 0 GROUP BY 1),
        sy AS (SELECT coalesce(a1.fp, a2.fp) AS fp, k1, k2 FROM a1 FULL JOIN a2 ON a1.fp = a2.fp)"""
    nm = "(SELECT sev FROM rk WHERE k = {c})"
    r.add(
        "mn3_sync_alerts",
        lambda s, d: synced(s, d)[0].select("alert_fingerprint", "current_severity", "previous_severity", "severity_change", "lifecycle_state", "occurrence_count", "consecutive_count",
                                            "escalation_count", "recovery_count", "first_seen_run_id", "last_seen_run_id"),
        f"""WITH {two} SELECT fp AS alert_fingerprint, {nm.format(c='coalesce(k2, k1)')} AS current_severity, CASE WHEN k1 IS NOT NULL AND k2 IS NOT NULL THEN {nm.format(c='k1')} END AS previous_severity,
        CASE WHEN k1 IS NULL OR k2 IS NULL THEN 'NEW' WHEN k2 > k1 THEN 'ESCALATED' WHEN k2 < k1 THEN 'DEESCALATED' ELSE 'UNCHANGED' END AS severity_change, CASE WHEN k2 IS NULL THEN 'RESOLVED' ELSE 'OPEN' END AS lifecycle_state,
        (k1 IS NOT NULL)::BIGINT + (k2 IS NOT NULL)::BIGINT AS occurrence_count, CASE WHEN k2 IS NULL THEN 0 WHEN k1 IS NULL THEN 1 ELSE 2 END::BIGINT AS consecutive_count,
        coalesce((k2 > k1)::BIGINT, 0) AS escalation_count, CASE WHEN k2 IS NULL OR k2 < k1 THEN 1 ELSE 0 END::BIGINT AS recovery_count,
        CASE WHEN k1 IS NULL THEN 'run2' ELSE 'run1' END AS first_seen_run_id, CASE WHEN k2 IS NULL THEN 'run1' ELSE 'run2' END AS last_seen_run_id FROM sy""",
    )
    r.add(
        "mn3_alert_events",
        lambda s, d: synced(s, d)[1].select("alert_fingerprint", "event"),
        f"""WITH {two} SELECT fp AS alert_fingerprint, 'CREATE' AS event FROM sy WHERE k1 IS NULL UNION ALL SELECT fp, 'ESCALATE' FROM sy WHERE k2 > k1 UNION ALL SELECT fp, 'DEESCALATE' FROM sy WHERE k2 < k1
        UNION ALL SELECT fp, 'AUTO_RESOLVE' FROM sy WHERE k2 IS NULL""",
    )

    # -- operator actions: the events of a user are a sequence of requested states
    def actions(s, d, key, names):
        e = table(s, d, "events")
        return e.select(F.concat(F.lit("K"), F.col("user_id").cast("string")).alias(key), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("action_id"),
                        F.col("ts").alias("acted_at"), F.get(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % len(names)).cast("int")).alias("target_state"))

    def fold(names, table_):
        allowed = " OR ".join(f"(st = '{a}' AND t IN ({', '.join(repr(x) for x in [a, *b])}))" for a, b in table_.items())
        lst = "[" + ", ".join(f"'{n}'" for n in names) + "]"
        return f"""WITH RECURSIVE ac AS (SELECT 'K' || user_id AS k, lpad(event_id::VARCHAR, 12, '0') AS id, {lst}[(event_id % {len(names)}) + 1] AS t,
            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
            fo AS (SELECT k, 0::BIGINT AS i, ''::VARCHAR AS id, ''::VARCHAR AS fs, 'OPEN' AS st, false AS ok FROM (SELECT DISTINCT k FROM ac) UNION ALL
            SELECT k, i, id, st, CASE WHEN good THEN t ELSE st END, good FROM (SELECT fo.k, ac.i, ac.id, fo.st, ac.t, ({allowed}) AS good FROM fo JOIN ac ON ac.k = fo.k AND ac.i = fo.i + 1) z)"""

    for name, key, table_, op in (("mn4_alert_actions", "alert_fingerprint", L.ALERT_TRANSITIONS, M.act_on_alerts), ("in8_incident_actions", "fingerprint", L.INCIDENT_TRANSITIONS, I.act_on_incidents)):
        names = list(table_)

        def query(s, d, key=key, names=names, op=op):
            a = actions(s, d, key, names)
            return op(a.select(key).distinct().withColumn("lifecycle_state", F.lit("OPEN")), a).select(key, "action_id", "from_state", "to_state", "accepted")

        r.add(name, query, f"{fold(names, table_)} SELECT k AS {key}, id AS action_id, fs AS from_state, st AS to_state, ok AS accepted FROM fo WHERE i > 0")

    # -- incidents
    r.add("in1_alert_links", lambda s, d: I.alert_links(order_alerts(s, d)), f"WITH {ALERT_SQL}, {HUBS} SELECT alert_id, hub FROM links")
    r.add(
        "in1_hub_scores",
        lambda s, d: I.hub_scores(order_alerts(s, d)),
        f"""WITH {ALERT_SQL}, {HUBS}, hd AS (SELECT hub, min(alert_id) AS head_id FROM links GROUP BY 1), p AS (SELECT l.hub, head_id, l.alert_id FROM links l JOIN hd USING (hub) WHERE head_id <> l.alert_id)
        SELECT hub, head_id, p.alert_id, least(100, CASE WHEN a.target_key = b.target_key AND a.target_key <> 'GLOBAL' THEN 35 ELSE 0 END + CASE WHEN a.investigation = b.investigation THEN 25 ELSE 0 END
        + CASE WHEN a.track = b.track THEN 20 ELSE 0 END + CASE WHEN a.first_run = b.first_run THEN 20 ELSE 0 END + CASE WHEN a.source_module = b.source_module THEN 10 ELSE 0 END
        + CASE WHEN a.metric_name = b.metric_name THEN 10 ELSE 0 END + CASE WHEN a.last_run = b.last_run THEN 10 ELSE 0 END)::BIGINT AS score FROM p JOIN al a ON a.alert_id = head_id JOIN al b ON b.alert_id = p.alert_id""",
    )
    r.add("in2_incident_clusters", clusters, f"WITH RECURSIVE {CLUSTERS} SELECT alert_id, incident_key FROM cl")

    def in_batches(s, d):
        """Three batches, stored once: a GLOBAL alert of a later one may tie alerts of an earlier one."""
        def build():
            state, all_, folder = C.empty_clusters(s), order_alerts(s, d), work_folder(s, "clusters")
            for i in range(3):
                C.add_alerts(state, all_.filter(F.pmod(F.expr("cast(alert_id as long)"), F.lit(3)) == 2 - i)).save(folder)
                state = C.load_clusters(s, folder, i + 1)
            return state.clusters().withColumn("part", F.lit("clusters")).unionByName(
                state.merges.filter("batch = 3").select(F.col("from_key").alias("alert_id"), F.col("into_key").alias("incident_key"), F.lit("merges").alias("part")))

        return stored(s, d, "cluster_batches", build)

    r.add("in2_incident_clusters_batches", lambda s, d: in_batches(s, d).filter("part = 'clusters'").select("alert_id", "incident_key"),
          f"WITH RECURSIVE {CLUSTERS} SELECT alert_id, incident_key FROM cl")
    earlier = CLUSTERS[len(ALERT_SQL):]
    earlier = ALERT_SQL.rstrip()[:-1] + " WHERE o_orderkey % 3 <> 0)" + earlier
    r.add("in9_cluster_merges", lambda s, d: in_batches(s, d).filter("part = 'merges'").groupBy("incident_key").agg(F.count("*").alias("merged")),
          f"""SELECT incident_key, count(DISTINCT old_key) - 1 AS merged FROM (WITH RECURSIVE {CLUSTERS} SELECT alert_id, incident_key FROM cl) w
          JOIN (WITH RECURSIVE {earlier} SELECT alert_id, incident_key AS old_key FROM cl) e USING (alert_id) GROUP BY 1 HAVING count(DISTINCT old_key) > 1""")
    r.add("in3_incident_identity", lambda s, d: identified(s, d).withColumn("modules", F.concat_ws(",", "modules")),
          f"""WITH RECURSIVE {CLUSTERS} SELECT incident_key, lineage_id, alerts, primary_target, modules, max_consecutive, escalating, severity, category, fingerprint,
          'INC-' || upper(substring(fingerprint, 1, 4)) AS code, title FROM inc""")
    state_ = lambda s, d: order_alerts(s, d).select("lineage_id").distinct().withColumn("health_state", F.lit("DEGRADED"))
    prio = lambda s, d: I.incident_priority(identified(s, d), state_(s, d))

    def clean_dims(s, d):
        k = F.expr("cast(substring(lineage_id, 2) as int)")
        ids = order_alerts(s, d).select("lineage_id").distinct()
        return ids.select("lineage_id", F.explode(F.array(F.lit("PERFORMANCE"), F.lit("DATA_QUALITY"))).alias("dimension"), F.when(k % 2 == 0, F.lit("HEALTHY")).otherwise(F.lit("DEGRADED")).alias("state"))

    r.add("in4_incident_priority", lambda s, d: prio(s, d).select("incident_key", "severity", "priority_score", "priority"),
          f"WITH RECURSIVE {CLUSTERS} SELECT incident_key, severity, priority_score::BIGINT AS priority_score, priority FROM pt")
    r.add("in5_contradictions", lambda s, d: I.contradictions(identified(s, d), clean_dims(s, d)).select("incident_key", "contradictory"),
          f"WITH RECURSIVE {CLUSTERS} SELECT incident_key, contradictory FROM pt")

    def decision(s, d):
        k = F.col("alerts")
        base = I.contradictions(prio(s, d), clean_dims(s, d))
        return I.incident_decision(base.withColumns({"has_investigation": k % 2 == 0, "has_remediation": k % 3 == 0, "has_validated": k % 7 == 0, "reopened": k % 11 == 0}))

    r.add("in6_incident_decision", lambda s, d: decision(s, d).select("incident_key", "decision", "decision_confidence"),
          f"""WITH RECURSIVE {CLUSTERS}, dc AS (SELECT *, CASE WHEN contradictory AND alerts % 3 <> 0 AND alerts % 7 <> 0 THEN 'MONITOR' WHEN alerts % 11 = 0 THEN 'REOPEN_INVESTIGATION'
          WHEN priority_score >= 85 AND nm >= 3 AND alerts % 3 <> 0 THEN 'ESCALATE' WHEN alerts % 7 = 0 THEN 'MONITOR' WHEN alerts % 3 = 0 THEN 'VALIDATE_REMEDIATION'
          WHEN alerts % 2 = 0 THEN 'REVIEW_REMEDIATION' ELSE 'INVESTIGATE' END AS decision FROM pt)
          SELECT incident_key, decision, CASE WHEN NOT contradictory AND (decision <> 'INVESTIGATE' OR nm >= 2) THEN 'HIGH' ELSE 'MEDIUM' END AS decision_confidence FROM dc""")
    r.add("in7_evidence_matrix", lambda s, d: I.evidence_matrix(order_alerts(s, d), clusters(s, d)),
          f"""WITH RECURSIVE {CLUSTERS} SELECT incident_key, source_module, count(*) AS alerts, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max(rk) + 1] AS worst_severity,
          string_agg(DISTINCT metric_name, ',' ORDER BY metric_name) AS metrics FROM mem GROUP BY 1, 2""")
    r.add("in9_sync_incidents", lambda s, d: I.sync_incidents(
        identified(s, d).groupBy("fingerprint").agg(F.max("alerts").alias("a")).filter(F.col("a") % 2 == 0).select(
            "fingerprint", F.when(F.col("a") % 4 == 0, F.lit("RESOLVED")).otherwise(F.lit("OPEN")).alias("lifecycle_state"), F.lit(0).cast("long").alias("reopen_count")),
        identified(s, d)).select("fingerprint", "code", "primary_target", "category", "alerts", "lifecycle_state", "reopen_count", "change"),
        f"""WITH RECURSIVE {CLUSTERS}, f AS (SELECT fingerprint, max(alerts) AS a, sum(alerts)::BIGINT AS alerts, any_value(primary_target) AS primary_target, any_value(category) AS category FROM inc GROUP BY 1)
        SELECT fingerprint, 'INC-' || upper(substring(fingerprint, 1, 4)) AS code, primary_target, category, alerts, CASE WHEN a % 4 = 0 THEN 'REOPENED' ELSE 'OPEN' END AS lifecycle_state,
        (a % 4 = 0)::BIGINT AS reopen_count, CASE WHEN a % 2 <> 0 THEN 'CREATED' WHEN a % 4 = 0 THEN 'REOPENED' ELSE 'UPDATED' END AS change FROM f""")

    def dossier(s, d):
        big = identified(s, d)
        first = big.agg(F.max_by("fingerprint", F.struct("alerts", "fingerprint")).alias("f")).first()["f"]
        rel = order_alerts(s, d).filter("target_key <> 'GLOBAL'").select("lineage_id", "target_key", F.lit("investigation").alias("kind"), F.col("alert_id").alias("id"))
        return I.incident_dossier(big, order_alerts(s, d), clusters(s, d), rel, first)

    r.add(
        "in10_incident_dossier", dossier,
        f"""WITH RECURSIVE {CLUSTERS}, big AS (SELECT fingerprint AS f FROM inc ORDER BY alerts DESC, fingerprint DESC LIMIT 1)
        SELECT fingerprint, 'INC-' || upper(substring(fingerprint, 1, 4)) AS code, title, alert_id, target_key, metric_name, source_module, mem.severity,
        CASE WHEN target_key <> 'GLOBAL' THEN 'investigation' END AS linked FROM mem JOIN inc USING (incident_key) JOIN big ON big.f = fingerprint""",
    )
    r.add(
        "jn8_link_alerts",
        lambda s, d: M.link_alerts(order_alerts(s, d), order_alerts(s, d).filter("target_key <> 'GLOBAL'").select(
            "lineage_id", "target_key", F.col("alert_id").alias("id"), F.col("consecutive_count").alias("priority_order")), "related").select("alert_id", "related_id"),
        f"""WITH {ALERT_SQL} SELECT alert_id, CASE WHEN target_key <> 'GLOBAL' THEN first_value(alert_id) OVER (PARTITION BY lineage_id, target_key ORDER BY consecutive_count, alert_id) END AS related_id FROM al""",
    )

    # -- reliability and fleet
    r.add(
        "rl1_trajectory",
        lambda s, d: rounded(R.trajectory(snapshots(s, d), 7).select("lineage_id", "run_index", "health_state", "score", "reliability_state")),
        f"""{TRAJ} SELECT lineage_id, run_index::BIGINT AS run_index, health_state, score, CASE WHEN score >= 88 AND health_state = 'HEALTHY' THEN 'HEALTHY' WHEN score >= 75 THEN 'STABLE' WHEN score >= 60 THEN 'DEGRADED'
        WHEN score >= 45 THEN 'AT_RISK' ELSE 'CRITICAL' END AS reliability_state FROM tj""",
    )
    r.add(
        "rl2_recovery_profile",
        lambda s, d: rounded(R.recovery_profile(traj(s, d))),
        f"""{TRAJ}, {REC} SELECT lineage_id, runs, periods, recoveries, greatest(periods - 1, 0) AS regressions, unresolved, {r6('CASE WHEN periods > 0 THEN recoveries::DOUBLE / periods ELSE 1 END', 'recovery_rate')} FROM rp""",
    )
    r.add("rl3_reliability_trend", lambda s, d: rounded(R.reliability_trend(traj(s, d))), f"{TRAJ}, {REC} SELECT lineage_id, n, {r6('slope', 'slope')}, {r6('r2', 'r2')}, trend FROM tq")
    r.add("rl4_reliability_score", lambda s, d: profiles(s, d).select("lineage_id", "deductions", "bonuses", "score"), f"{TRAJ}, {REC} SELECT lineage_id, ded::BIGINT AS deductions, bon::BIGINT AS bonuses, score FROM sd")
    r.add("rl4_score_breakdown", lambda s, d: R.score_breakdown(inputs(s, d)).groupBy("lineage_id").agg(F.sum("points").alias("points")), f"{TRAJ}, {REC} SELECT lineage_id, (bon - ded)::BIGINT AS points FROM sd WHERE bon <> 0 OR ded <> 0")
    r.add(
        "rl5_reliability_state",
        lambda s, d: profiles(s, d).select("lineage_id", "score", "reliability_state", "grade", "confidence", "recommendation"),
        f"{TRAJ}, {REC} SELECT lineage_id, score, rs AS reliability_state, grade, conf AS confidence, rec AS recommendation FROM pf",
    )
    r.add(
        "rl6_durability_summary",
        lambda s, d: rounded(R.durability_summary(T.durability(experiments(s, d), observations(s, d), T.run_index(runs(s, d))))),
        f"""WITH {ALERTS}, k AS (SELECT lineage_id, count(*) FILTER (status = 'SUSTAINED') AS sustained, count(*) FILTER (status = 'TEMPORARY') AS temporary, count(*) FILTER (status = 'FAILED_TO_SUSTAIN') AS failed,
        count(*) FILTER (status = 'INSUFFICIENT_FOLLOWUP') AS pending FROM durab GROUP BY 1) SELECT *, {r6('sustained::DOUBLE / nullif(sustained + temporary + failed, 0)', 'durability_rate')} FROM k""",
    )
    r.add(
        "rl7_reliability_factors",
        lambda s, d: R.reliability_factors(profiles(s, d)).select("lineage_id", "kind", "factor"),
        f"""{TRAJ}, {REC} SELECT lineage_id, 'RISK' AS kind, 'critical_incidents' AS factor FROM pf WHERE crit > 0 UNION ALL SELECT lineage_id, 'RISK', 'degrading_trend' FROM pf WHERE trend = 'DEGRADING'
        UNION ALL SELECT lineage_id, 'RISK', 'reopened_incidents' FROM pf WHERE reop > 0 UNION ALL SELECT lineage_id, 'RISK', 'weak_remediations' FROM pf WHERE tmp > 0 OR fail > 0
        UNION ALL SELECT lineage_id, 'RISK', 'regressions' FROM pf WHERE regr > 0 UNION ALL SELECT lineage_id, 'STRENGTH', 'clean_operation' FROM pf WHERE score >= 80 AND active = 0
        UNION ALL SELECT lineage_id, 'STRENGTH', 'sustained_remediations' FROM pf WHERE sus > 0 UNION ALL SELECT lineage_id, 'STRENGTH', 'full_recovery' FROM pf WHERE recoveries > 0 AND unresolved = 0
        UNION ALL SELECT lineage_id, 'STRENGTH', 'improving_trend' FROM pf WHERE trend = 'IMPROVING'""",
    )
    r.add(
        "rl7_last_runs",
        lambda s, d: R.last_runs_by_health(snapshots(s, d)),
        f"""WITH {SNAP} SELECT lineage_id, {', '.join(f"max_by(lineage_id || ':' || d::VARCHAR, run_index) FILTER (health_state = '{h}') AS last_{h.lower()}_run" for h in ('HEALTHY', 'DEGRADED', 'CRITICAL'))} FROM sx GROUP BY 1""",
    )
    ev = lambda s, d: R.profile_events(profiles(s, d))
    r.add(
        "rl8_governance_events",
        lambda s, d: R.governance_events(ev(s, d).filter("event_type = 'RECOMMENDATION'"), ev(s, d)),
        f"{TRAJ}, {REC} SELECT lineage_id, 'RELIABILITY_STATE' AS event_type, 'PROFILE' AS source_type, rs AS source_id FROM pf",
    )
    counts = ", ".join(f"count(*) FILTER (rs = '{x}') AS {x.lower()}" for x in R.STATES)
    r.add("fl1_fleet_overview", lambda s, d: rounded(R.fleet_overview(profiles(s, d))),
          f"{TRAJ}, {REC} SELECT count(*) AS lineages, {r6('avg(score)', 'mean_score')}, {counts}, count(*) FILTER (trend = 'DEGRADING') AS degrading, sum(active)::BIGINT AS active_incidents FROM pf")
    place = lambda c, names: f"coalesce(nullif(list_position([{', '.join(repr(n) for n in names)}], {c}), 0), 10)"
    r.add(
        "fl2_fleet_ranking",
        lambda s, d: R.fleet_ranking(profiles(s, d)).drop("reasons"),
        f"""{TRAJ}, {REC} SELECT row_number() OVER (ORDER BY {place('rs', R.STATES)}, crit DESC, {place('trend', R.TRENDS)}, reop DESC, score, lineage_id) AS rank, lineage_id, rs AS reliability_state, score, trend,
        CASE WHEN rs = 'CRITICAL' OR hs = 'CRITICAL' OR crit > 0 OR score < 50 THEN 'CRITICAL' WHEN rs = 'AT_RISK' OR score < 65 THEN 'HIGH' WHEN rs = 'DEGRADED' OR trend = 'DEGRADING' OR score < 78 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM pf""",
    )
    r.add(
        "fl3_risk_matrix",
        lambda s, d: R.risk_matrix(profiles(s, d)),
        f"""{TRAJ}, {REC}, ce(health, trend, risk) AS (VALUES ('HEALTHY', 'IMPROVING', 'LOW'), ('HEALTHY', 'STABLE', 'LOW'), ('HEALTHY', 'DEGRADING', 'MEDIUM'), ('DEGRADED', 'IMPROVING', 'LOW'), ('DEGRADED', 'STABLE', 'MEDIUM'),
        ('DEGRADED', 'DEGRADING', 'HIGH'), ('CRITICAL', 'IMPROVING', 'MEDIUM'), ('CRITICAL', 'STABLE', 'HIGH'), ('CRITICAL', 'DEGRADING', 'CRITICAL')),
        pp AS (SELECT CASE WHEN hs IN ('HEALTHY', 'DEGRADED', 'CRITICAL') THEN hs ELSE 'HEALTHY' END AS health, CASE WHEN trend IN ('IMPROVING', 'STABLE', 'DEGRADING') THEN trend ELSE 'STABLE' END AS trend FROM pf)
        SELECT health, trend, risk, (SELECT count(*) FROM pp WHERE pp.health = ce.health AND pp.trend = ce.trend) AS lineages FROM ce""",
    )
    r.add(
        "fl3_risk_matrix_lineages",
        lambda s, d: R.risk_matrix_lineages(profiles(s, d)),
        f"""{TRAJ}, {REC}, ce(health, trend, risk) AS (VALUES ('HEALTHY', 'IMPROVING', 'LOW'), ('HEALTHY', 'STABLE', 'LOW'), ('HEALTHY', 'DEGRADING', 'MEDIUM'), ('DEGRADED', 'IMPROVING', 'LOW'), ('DEGRADED', 'STABLE', 'MEDIUM'),
        ('DEGRADED', 'DEGRADING', 'HIGH'), ('CRITICAL', 'IMPROVING', 'MEDIUM'), ('CRITICAL', 'STABLE', 'HIGH'), ('CRITICAL', 'DEGRADING', 'CRITICAL')),
        pp AS (SELECT CASE WHEN hs IN ('HEALTHY', 'DEGRADED', 'CRITICAL') THEN hs ELSE 'HEALTHY' END AS health, CASE WHEN trend IN ('IMPROVING', 'STABLE', 'DEGRADING') THEN trend ELSE 'STABLE' END AS trend, lineage_id FROM pf)
        SELECT health, trend, risk, lineage_id FROM pp JOIN ce USING (health, trend)""",
    )
    r.add(
        "fl4_fleet_patterns",
        lambda s, d: R.fleet_patterns(profiles(s, d)),
        f"""{TRAJ}, {REC}, z AS (SELECT 'INCIDENT_REOPENING' AS pattern FROM pf WHERE reop > 0 UNION ALL SELECT 'REMEDIATION_FAILURE' FROM pf WHERE fail > 0 OR tmp > 0 UNION ALL SELECT 'DEGRADING_RELIABILITY' FROM pf WHERE trend = 'DEGRADING')
        SELECT pattern, count(*) AS lineages FROM z GROUP BY 1 HAVING count(*) >= 2""",
    )
    sides = {"score": "score", "slope": "slope", "active_incidents": "active", "regressions": "regr", "sustained": "sus"}
    r.add(
        "fl5_compare_lineages",
        lambda s, d: rounded(R.compare_lineages(profiles(s, d), "L1", "L2").filter(F.col("metric").isin(*sides))),
        f"{TRAJ}, {REC} " + " UNION ALL ".join(f"SELECT '{n}' AS metric, {r6('a.' + c, 'first')}, {r6('b.' + c, 'second')}, {r6(f'b.{c} - a.{c}', 'difference')} FROM pf a, pf b WHERE a.lineage_id = 'L1' AND b.lineage_id = 'L2'"
                                                for n, c in sides.items()),
    )
    a, b = "view:2024-01-05", "view:2024-01-06"
    r.add(
        "ex12_compare_runs",
        lambda s, d: rounded(X.compare_runs(observations(s, d), a, b)),
        f"""WITH {OBS}, c AS (SELECT metric_name, max(v) FILTER (run_id = '{a}') AS x, max(v) FILTER (run_id = '{b}') AS y FROM obs WHERE target_key = 'GLOBAL' AND metric_name = 'overall_error_rate' GROUP BY 1)
        SELECT 'ERROR_FORENSICS' AS module, metric_name, {r6('x', 'baseline')}, {r6('y', 'candidate')}, {r6('y - x', 'delta')}, CASE WHEN abs(y - x) < 0.005 THEN 'NO_MATERIAL_CHANGE' WHEN y < x THEN 'IMPROVED' ELSE 'REGRESSED' END AS direction FROM c""",
    )
    r.add(
        "ex12_overall_assessment",
        lambda s, d: X.overall_assessment(X.compare_runs(observations(s, d), a, b)),
        f"""WITH {OBS}, c AS (SELECT max(v) FILTER (run_id = '{a}') AS x, max(v) FILTER (run_id = '{b}') AS y FROM obs WHERE metric_name = 'overall_error_rate'),
        k AS (SELECT (abs(y - x) >= 0.005 AND y < x)::BIGINT AS improved, (abs(y - x) >= 0.005 AND y > x)::BIGINT AS regressed, (abs(y - x) < 0.005)::BIGINT AS unchanged FROM c)
        SELECT improved, regressed, unchanged, 0::BIGINT AS missing, CASE WHEN improved > 0 THEN 'IMPROVED' WHEN regressed > 0 THEN 'REGRESSED' ELSE 'NO_MATERIAL_CHANGE' END AS assessment FROM k""",
    )
