"""Joins, sorts and whole audits that cut across the families."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import monitoring as M
from plumbline.operators import temporal as T
from plumbline.operators.scoring import LinearModel
from plumbline.plans.audit import AuditConfig, run_audit
from plumbline.plans.watch import incidents_of, watch

from .common import SCORED_DOCS, Registry, r6, rounded, scored_docs, table
from .history import OBS, normalized, observations, runs


def register(r: Registry) -> None:
    r.add(
        "jn3_run_lookup",
        lambda s, d: rounded(T.run_index(runs(s, d)).join(observations(s, d).filter("target_key = 'GLOBAL' and metric_name = 'accuracy'").select(
            "run_id", F.col("metric_value").alias("accuracy")), "run_id", "left").select("lineage_id", "run_id", "run_index", "accuracy")),
        f"WITH {OBS} SELECT rn.lineage_id, rn.run_id, rn.run_index::BIGINT AS run_index, {r6('v', 'accuracy')} FROM rn LEFT JOIN obs ON obs.run_id = rn.run_id AND metric_name = 'accuracy'",
    )
    r.add(
        "jn4_metric_lookup",
        lambda s, d: rounded(observations(s, d).join(F.broadcast(T.registry(s).select("metric_name", "warning", "critical")), "metric_name").groupBy(
            "metric_name").agg(F.count(F.lit(1)).alias("n"), F.max("warning").alias("warning"), F.max("critical").alias("critical"))),
        f"WITH {OBS} SELECT metric_name, count(*) AS n, {r6('max(warning)', 'warning')}, {r6('max(critical)', 'critical')} FROM obs JOIN reg USING (metric_name) GROUP BY 1",
    )
    r.add(
        "tm2_metric_registry",
        lambda s, d: rounded(T.registry(s).join(observations(s, d).select("metric_name").distinct(), "metric_name", "left_semi").select("metric_name", "higher_is_better", "warning", "critical")),
        f"WITH {OBS} SELECT metric_name, higher AS higher_is_better, {r6('warning', 'warning')}, {r6('critical', 'critical')} FROM reg WHERE metric_name IN (SELECT metric_name FROM obs)",
    )
    r.add(
        "st1_set_operations",
        lambda s, d: table(s, d, "orders").select(F.col("o_custkey").alias("k")).distinct().exceptAll(table(s, d, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("k")))
        .intersect(table(s, d, "customer").select(F.col("c_custkey").alias("k"))).agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total")),
        """SELECT count(*) AS n, sum(k)::BIGINT AS total FROM (SELECT DISTINCT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') x
        WHERE k IN (SELECT c_custkey FROM customer)""",
    )
    r.add(
        "st2_ranked_top_k",
        lambda s, d: rounded(table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")),
        f"SELECT o_orderkey, {r6('o_totalprice', 'o_totalprice')} FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    )

    def audit(s, d):
        docs = scored_docs(s, d).select("doc_id", "lang", "source", "n_chars", "y", F.col("p").alias("pred_prob"))
        even = F.col("doc_id") % 2 == 0
        model = LinearModel({"n_chars": 0.0005}, -1.0)
        cfg = AuditConfig("y", protected="lang", model=model, key=["doc_id"], features=["n_chars"], categorical=["source"])
        return run_audit("audit-1", docs.filter(~even), cfg, docs.filter(even))

    def audited(s, d):
        a = audit(s, d)
        return a.modules.join(a.health.select("module", "n_findings", "health_score", "passed"), "module", "left")

    r.add("run_audit_modules", audited)
    r.add(
        "run_audit_metrics",
        lambda s, d: rounded(audit(s, d).metrics.filter("module IN ('PERFORMANCE', 'EXPLAINABILITY') AND metric_name IN ('accuracy', 'share', 'rank', 'mean_abs')")),
        f"""WITH {SCORED_DOCS}, ev AS (SELECT * FROM scored WHERE doc_id % 2 <> 0)
        SELECT 'PERFORMANCE' AS module, NULL AS feature, 'accuracy' AS metric_name, {r6('avg(((p >= 0.5)::INT = y)::INT::DOUBLE)', 'metric_value')}, 'audit-1' AS run_id FROM ev
        UNION ALL SELECT 'EXPLAINABILITY', 'n_chars', 'share', 1.0, 'audit-1' UNION ALL SELECT 'EXPLAINABILITY', 'n_chars', 'rank', 1.0, 'audit-1'
        UNION ALL SELECT 'EXPLAINABILITY', 'n_chars', 'mean_abs', {r6('avg(abs(0.0005 * (n_chars - m)))', 'v')}, 'audit-1' FROM ev, (SELECT avg(n_chars) AS m FROM ev) q""",
    )

    def watched(s, d):
        return watch(normalized(s, d), runs(s, d), M.empty_state(s), F.lit("latest"), F.lit("2024-02-01").cast("timestamp"))

    r.add("watch_decisions", lambda s, d: watched(s, d).decision)

    def open_incidents(s, d):
        w = watched(s, d)
        return incidents_of(w.alerts, w.decision).groupBy("lineage_id", "priority").agg(F.count(F.lit(1)).alias("n"), F.sum("alerts").alias("alerts"))

    r.add("watch_incidents", open_incidents)
