"""Normalisation, rules, investigations, remediations and the evidence graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import rules as U
from plumbline.sources.normalize import normalize_results

from .common import Registry, r6, rounded, stored
from .results import CORR, WIDE, results


def norm(s, d):
    return stored(s, d, "norm", lambda: normalize_results(results(s, d)))


def parts(s, d):
    n = norm(s, d)
    wide, runs = stored(s, d, "wide", lambda: U.evidence_wide(n)), stored(s, d, "run_level", lambda: U.run_level(n))
    return n, wide, runs, stored(s, d, "correlations", lambda: U.correlations(wide, runs))


def investigated(s, d):
    return stored(s, d, "investigations", lambda: U.investigations(norm(s, d), *parts(s, d)[1:]))


EVID = """CASE WHEN psi >= 0.05 OR drifted THEN 'DRIFT' END, CASE WHEN rank <= 5 OR share >= 0.05 OR attr_abs > 0.05 THEN 'EXPLAINABILITY' END,
  CASE WHEN flip >= 0.01 OR srank <= 3 THEN 'ROBUSTNESS' END, CASE WHEN enr OR assoc >= 0.10 OR abs(fp) >= 0.20 OR abs(fn) >= 0.20 THEN 'ERROR_FORENSICS' END,
  CASE WHEN susp OR leak >= 0.50 OR mi >= 0.20 THEN 'LEAKAGE' END, CASE WHEN nulls >= 0.01 OR outl >= 0.05 OR const THEN 'DATA_QUALITY' END"""
LEVEL = "CASE WHEN sc >= 85 THEN 'CRITICAL' WHEN sc >= 65 THEN 'HIGH' WHEN sc >= 45 THEN 'MEDIUM' WHEN sc >= 25 THEN 'LOW' ELSE 'INFO' END"
CONF = "CASE WHEN m >= 3 OR (m >= 2 AND sc >= 80) THEN 'HIGH' WHEN m >= 2 OR sc >= 60 THEN 'MEDIUM' ELSE 'LOW' END"
INV = f"""{CORR}, cf AS (SELECT run_id, feature, max(score) AS rs, count(*) AS findings, string_agg(modules, ',') AS rm FROM corr_ WHERE feature IS NOT NULL GROUP BY 1, 2),
own AS (SELECT fw.*, rs, coalesce(findings, 0) AS findings, coalesce(string_split(rm, ','), []) AS rms, list_filter([{EVID}], lambda q: q IS NOT NULL) AS ev FROM fw LEFT JOIN cf USING (run_id, feature)),
fi AS (SELECT *, len(list_distinct(list_concat(ev, rms))) AS m, list_sort(list_distinct(list_concat(ev, rms))) AS sm FROM own),
fs AS (SELECT *, least(greatest(coalesce(rs, CASE WHEN psi >= 0.25 THEN 70 WHEN enr THEN 65 WHEN rank <= 2 THEN 55 ELSE 30 END) + least((m - 1) * 3.5, 14) + least(
  CASE WHEN psi >= 0.25 THEN 3 WHEN psi >= 0.1 THEN 1.5 ELSE 0 END + CASE WHEN rank = 1 THEN 3 WHEN rank <= 3 THEN 1.5 ELSE 0 END
  + CASE WHEN assoc >= 0.25 THEN 3 WHEN assoc >= 0.15 THEN 1.5 ELSE 0 END + CASE WHEN flip >= 0.1 THEN 2.5 WHEN flip >= 0.03 THEN 1 ELSE 0 END, 10), 10), 99.5)::DOUBLE AS sc FROM fi WHERE m > 0 OR findings > 0),
sgk AS (SELECT run_id, count(*) AS k FROM corr_ WHERE rule IN ('error_bias', 'bias_performance', 'bias_drift', 'multi_fairness_shift') GROUP BY 1),
sg AS (SELECT run_id, 'SUBGROUP::' || coalesce(attr, 'subgroup') || '=' || grp AS target_key, coalesce(k, 0) AS findings, CASE WHEN has_bias THEN 2 ELSE 1 END AS m,
  least(60 + CASE WHEN rate >= 0.15 THEN 15 ELSE 0 END + CASE WHEN has_bias AND dir <= 0.8 THEN 12 ELSE 0 END + least(coalesce(k, 0) * 3.0, 10), 98)::DOUBLE AS sc,
  CASE WHEN has_bias THEN ['BIAS', 'ERROR_FORENSICS'] ELSE ['ERROR_FORENSICS'] END AS sm
  FROM (SELECT *, 'a' AS grp, ga AS rate FROM rn UNION ALL SELECT *, 'b', gb FROM rn) z LEFT JOIN sgk USING (run_id)),
bh AS (SELECT rn.run_id, count(c.rule) AS findings, max(least(75 + least(hce * 40, 15) + CASE WHEN fece >= 0.1 THEN 6 ELSE 0 END, 98))::DOUBLE AS sc FROM rn LEFT JOIN corr_ c ON c.run_id = rn.run_id AND c.rule = 'confidence_calibration_error'
  WHERE hcn > 0 OR hce >= 0.1 GROUP BY 1),
inv AS (SELECT run_id, 'FEATURE' AS target_type, 'FEATURE::' || feature AS target_key, sm, findings::BIGINT AS findings, len(ev)::BIGINT AS evidence, sc, m FROM fs
  UNION ALL SELECT run_id, 'SUBGROUP', target_key, sm, findings, m, sc, m FROM sg
  UNION ALL SELECT run_id, 'BEHAVIOR', 'BEHAVIOR::HIGH_CONFIDENCE_ERRORS', ['ERROR_FORENSICS', 'PERFORMANCE'], findings, 2, sc, 2 FROM bh)"""

_FEATURE_REMS = [
    ("DATA_LEAKAGE_REVIEW", "leak >= 0.70 OR mi >= 0.50 OR corr >= 0.80", "least(88 + least(leak * 10, 10), 99)", "'CRITICAL'", "HIGH"),
    ("DATA_QUALITY_REPAIR", "nulls >= 0.15 OR outl >= 0.05 OR const", "least(65 + least(nulls * 25, 15) + CASE WHEN outl >= 0.05 THEN 5 ELSE 0 END, 88)",
     "CASE WHEN 65 + least(nulls * 25, 15) + CASE WHEN outl >= 0.05 THEN 5 ELSE 0 END >= 75 THEN 'CRITICAL' ELSE 'HIGH' END", "MEDIUM"),
    ("DISTRIBUTION_SHIFT_INVESTIGATION", "psi >= 0.25", "least(85 + least(psi * 4, 10) + CASE WHEN assoc >= 0.20 THEN 4 ELSE 0 END, 99.5)", "'CRITICAL'", "HIGH"),
    ("FEATURE_ENGINEERING_REVIEW", "rank <= 3 AND (assoc >= 0.20 OR enr)", "least(80 + (4 - rank) * 3 + least(assoc * 20, 10), 98)", "'CRITICAL'", "HIGH"),
    ("FEATURE_REMOVAL_REVIEW", "leak >= 0.70 OR susp OR (nulls >= 0.15 AND assoc >= 0.25 AND flip >= 0.10)", "91", "'CRITICAL'", "HIGH"),
    ("ROBUSTNESS_REVIEW", "flip >= 0.10 OR srank <= 2", "least(78 + least(flip * 30, 15), 94)", "CASE WHEN 78 + least(flip * 30, 15) >= 85 THEN 'CRITICAL' ELSE 'HIGH' END", "HIGH"),
]
_has = lambda *names: "EXISTS (SELECT 1 FROM corr_ c WHERE c.run_id = rn.run_id AND c.rule IN (" + ", ".join(f"'{n}'" for n in names) + "))"
_RUN_REMS = [
    ("CALIBRATION_REVIEW", "'BEHAVIOR'", "'BEHAVIOR::CALIBRATION_FAILURE'", f"ece >= 0.08 OR brier >= 0.20 OR {_has('confidence_calibration_error')}", "least(75 + least(ece * 80, 15), 92)",
     "CASE WHEN 75 + least(ece * 80, 15) >= 80 THEN 'CRITICAL' ELSE 'HIGH' END"),
    ("ERROR_SEGMENT_REVIEW", "'BEHAVIOR'", "'BEHAVIOR::HIGH_CONFIDENCE_ERRORS'", f"{_has('confidence_calibration_error')} OR EXISTS (SELECT 1 FROM fw WHERE fw.run_id = rn.run_id AND enr)", "82", "'HIGH'"),
    ("FAIRNESS_REVIEW", "'SUBGROUP'", "'SUBGROUP::' || coalesce(attr, 'protected_attribute')",
     f"coalesce(dir < 0.80 OR eo >= 0.10 OR dp >= 0.10, false) OR {_has('bias_drift', 'bias_performance', 'error_bias', 'multi_fairness_shift')}", "86", "'CRITICAL'"),
    ("MODEL_COMPLEXITY_REVIEW", "'GLOBAL'", "'GLOBAL::MODEL_COMPLEXITY'", _has("multi_fragile_feature"), "79", "'HIGH'"),
    ("THRESHOLD_REVIEW", "'GLOBAL'", "'GLOBAL::THRESHOLD_TUNING'", "true", "72", "'HIGH'"),
]
REM = f"{CORR}, rem AS (" + " UNION ALL ".join(
    [f"SELECT run_id, 'FEATURE' AS target_type, 'FEATURE::' || feature AS target_key, '{k}' AS remediation_type, ({s})::DOUBLE AS score, {p} AS priority, '{c}' AS confidence FROM fw WHERE {w}"
     for k, w, s, p, c in _FEATURE_REMS]
    + [f"SELECT run_id, {t}, {key}, '{k}', ({s})::DOUBLE, {p}, 'HIGH' FROM rn WHERE {w}" for k, t, key, w, s, p in _RUN_REMS]) + ")"


def register(r: Registry) -> None:
    names = {"psi": "psi", "importance_rank": "rank", "attribution_share": "share", "sensitivity_rank": "srank", "flip_rate": "flip", "mutual_info": "mi", "leakage_score": "leak",
             "null_rate": "nulls", "outlier_rate": "outl", "distinct_count": "dn", "error_association": "assoc", "error_p": "p", "fp_separation": "fp", "fn_separation": "fn"}
    r.add(
        "nm1_normalize_features",
        lambda s, d: rounded(norm(s, d).filter(F.col("metric_name").isin("psi", "importance_rank", "sensitivity_rank", "flip_rate", "mutual_info", "leakage_score", "null_rate", "outlier_rate",
                                                                         "distinct_count", "error_association", "error_p", "fp_separation", "fn_separation", "is_suspicious", "is_constant"))
                             .groupBy("module", "metric_name", "target_key").agg(F.count("metric_value").alias("n"), F.sum("metric_value").alias("total"))),
        f"WITH {WIDE}, u AS (" + " UNION ALL ".join(
            f"SELECT '{m}' AS module, '{n}' AS metric_name, feature, ({c})::DOUBLE AS v FROM fw" for m, n, c in (
                ("DRIFT", "psi", "psi"), ("EXPLAINABILITY", "importance_rank", "rank"), ("ROBUSTNESS", "sensitivity_rank", "srank"), ("ROBUSTNESS", "flip_rate", "flip"),
                ("LEAKAGE", "mutual_info", "mi"), ("LEAKAGE", "leakage_score", "leak"), ("LEAKAGE", "is_suspicious", "susp::INT"), ("DATA_QUALITY", "null_rate", "nulls"),
                ("DATA_QUALITY", "outlier_rate", "outl"), ("DATA_QUALITY", "distinct_count", "dn"), ("DATA_QUALITY", "is_constant", "const::INT"), ("ERROR_FORENSICS", "error_association", "assoc"),
                ("ERROR_FORENSICS", "error_p", "p"), ("ERROR_FORENSICS", "fp_separation", "fp"), ("ERROR_FORENSICS", "fn_separation", "fn"))) +
        f") SELECT module, metric_name, 'FEATURE::' || feature AS target_key, count(v) AS n, {r6('sum(v)', 'total')} FROM u WHERE v IS NOT NULL GROUP BY 1, 2, 3",
    )
    r.add(
        "nm1_normalize_runs",
        lambda s, d: rounded(U.run_level(norm(s, d)).select(
            "run_id", "f1", "expected_calibration_error", "worst_disparate_impact_ratio", "high_confidence_error_count", "subgroup_disparity_ratio", "protected_attribute",
            (F.col("severe_calibration_bins") > 0).alias("severe"), F.concat_ws(",", "modules").alias("modules"))),
        f"""WITH {WIDE} SELECT run_id, {r6('f1', 'f1')}, {r6('ece', 'expected_calibration_error')}, {r6('dir', 'worst_disparate_impact_ratio')}, {r6('hcn', 'high_confidence_error_count')},
        {r6('disp', 'subgroup_disparity_ratio')}, attr AS protected_attribute, severe, CASE WHEN has_bias THEN 'BIAS,' ELSE '' END || 'DATA_QUALITY,DRIFT,ERROR_FORENSICS,EXPLAINABILITY,LEAKAGE,PERFORMANCE' ||
        CASE WHEN has_rob THEN ',ROBUSTNESS' ELSE '' END AS modules FROM rn""",
    )
    r.add(
        "cr1_evidence_wide",
        lambda s, d: rounded(U.evidence_wide(norm(s, d)).select("run_id", "feature", *names, "drifted", "error_enriched")),
        f"WITH {WIDE} SELECT run_id, feature, {', '.join(r6(c, n) for n, c in names.items())}, drifted, enr AS error_enriched FROM fw",
    )
    from .results import _RULES

    for i, rule in enumerate(_RULES):
        name = rule[0]
        r.add(
            f"cr{i + 2}_{name}",
            lambda s, d, n=name: parts(s, d)[3].filter(F.col("rule") == n).withColumn("rule_modules", F.concat_ws(",", "rule_modules")),
            f"WITH {CORR} SELECT run_id, feature, rule, modules AS rule_modules, severity, priority, confidence, score::DOUBLE AS score FROM corr_ WHERE rule = '{name}'",
        )
    r.add(
        "cr19_priority_score",
        lambda s, d: parts(s, d)[3].groupBy("rule", "priority", "severity").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score")),
        f"WITH {CORR} SELECT rule, priority, severity, count(*) AS n, max(score)::DOUBLE AS score FROM corr_ GROUP BY 1, 2, 3",
    )
    r.add(
        "cr20_run_summary",
        lambda s, d: U.run_summary(parts(s, d)[3], results(s, d)),
        f"""WITH {CORR}, a AS (SELECT run_id, count(*) AS correlations, count(*) FILTER (priority = 'CRITICAL') AS critical, count(*) FILTER (priority = 'HIGH') AS high,
        count(*) FILTER (priority = 'MEDIUM') AS medium, count(*) FILTER (priority = 'LOW') AS low, max(score)::DOUBLE AS max_score FROM corr_ GROUP BY 1),
        t AS (SELECT run_id, feature, sum(score) AS s FROM corr_ WHERE feature IS NOT NULL GROUP BY 1, 2), tf AS (SELECT run_id, count(*) AS features,
        arg_min(feature, struct_pack(a := -s, b := feature)) AS top_feature FROM t GROUP BY 1)
        SELECT rn.run_id, 6 + has_bias::BIGINT + has_rob::BIGINT AS modules_completed, 2 - has_bias::BIGINT - has_rob::BIGINT AS modules_failed, coalesce(correlations, 0) AS correlations,
        coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, max_score, top_feature, coalesce(features, 0) AS features
        FROM rn LEFT JOIN a USING (run_id) LEFT JOIN tf USING (run_id)""",
    )
    r.add(
        "cr20_feature_profiles",
        lambda s, d: rounded(U.feature_profiles(parts(s, d)[3])),
        f"""WITH {CORR} SELECT run_id, feature, count(*) AS rules, sum(score)::DOUBLE AS total_score, max(score)::DOUBLE AS max_score,
        len(list_distinct(string_split(string_agg(modules, ','), ',')))::BIGINT AS modules FROM corr_ WHERE feature IS NOT NULL GROUP BY 1, 2""",
    )
    r.add(
        "cr20_module_contributions",
        lambda s, d: U.module_contributions(parts(s, d)[3]),
        f"""WITH {CORR}, u AS (SELECT run_id, score, unnest(string_split(modules, ',')) AS module FROM corr_) SELECT run_id, module, count(*) AS rules, sum(score)::DOUBLE AS score FROM u GROUP BY 1, 2""",
    )
    shown = f"""run_id, target_type, target_key, array_to_string(sm, ',') AS supporting_modules, findings, evidence, round(sc, 1) AS score, {LEVEL} AS priority, {CONF} AS confidence"""
    for i, kind in enumerate(("FEATURE", "SUBGROUP", "BEHAVIOR"), 1):
        r.add(
            f"iv{i}_{kind.lower()}_investigations",
            lambda s, d, k=kind: investigated(s, d).filter(F.col("target_type") == k).withColumn("supporting_modules", F.concat_ws(",", "supporting_modules")),
            f"WITH {INV} SELECT {shown} FROM inv WHERE target_type = '{kind}'",
        )

    def edges(s, d):
        n, wide, _, corr = parts(s, d)
        return U.evidence_edges(investigated(s, d), corr, wide)

    fw_edges = "FROM fw JOIN (SELECT run_id, substring(target_key, 10) AS feature, target_key FROM top WHERE target_type = 'FEATURE') t USING (run_id, feature)"
    graph = f"""{INV}, top AS (SELECT * FROM inv),
        fk AS (SELECT *, 'FINDING|' || rule || '|' || coalesce(feature, 'GLOBAL') AS node FROM corr_),
        eg AS (SELECT run_id, 'PRODUCES' AS edge_type, 'MODULE|' || unnest(string_split(modules, ',')) AS source, node AS target, score::DOUBLE AS weight FROM fk
        UNION ALL SELECT fk.run_id, 'IMPLICATES', node, 'TARGET|' || target_key, score FROM fk JOIN top ON top.run_id = fk.run_id AND top.target_key = 'FEATURE::' || feature
        UNION ALL SELECT run_id, 'OBSERVES', 'MODULE|' || unnest(sm), 'TARGET|' || target_key, round(sc, 1) FROM top
        UNION ALL SELECT run_id, 'INFLUENCES', 'TARGET|' || target_key, 'MODULE|EXPLAINABILITY', share {fw_edges} WHERE rank <= 5
        UNION ALL SELECT run_id, 'ASSOCIATED_WITH', 'TARGET|' || target_key, 'MODULE|ERROR_FORENSICS', assoc {fw_edges} WHERE enr OR assoc >= 0.10
        UNION ALL SELECT run_id, 'SENSITIVE_UNDER', 'TARGET|' || target_key, 'MODULE|ROBUSTNESS', flip {fw_edges} WHERE flip >= 0.02 OR srank <= 3)"""
    r.add("iv4_evidence_edges", lambda s, d: rounded(edges(s, d)), f"WITH {graph} SELECT run_id, edge_type, source, target, {r6('weight', 'weight')} FROM eg")
    r.add(
        "iv4_evidence_nodes",
        lambda s, d: U.evidence_nodes(edges(s, d)),
        f"""WITH {graph}, e AS (SELECT run_id, source AS node FROM eg UNION ALL SELECT run_id, target FROM eg) SELECT run_id, node, count(*) AS degree, split_part(node, '|', 1) AS node_type FROM e GROUP BY 1, 2""",
    )
    r.add("iv5_dossier", lambda s, d: rounded(U.dossier(norm(s, d), "S5", "FEATURE::f3")))
    rem = lambda s, d: (lambda p: U.remediations(p[1], p[2], p[3]))(parts(s, d))
    kinds = [k[0] for k in _FEATURE_REMS] + [k[0] for k in _RUN_REMS]
    order = ["CALIBRATION_REVIEW", "DATA_LEAKAGE_REVIEW", "DATA_QUALITY_REPAIR", "DISTRIBUTION_SHIFT_INVESTIGATION", "ERROR_SEGMENT_REVIEW", "FAIRNESS_REVIEW", "FEATURE_ENGINEERING_REVIEW",
             "FEATURE_REMOVAL_REVIEW", "MODEL_COMPLEXITY_REVIEW", "ROBUSTNESS_REVIEW", "THRESHOLD_REVIEW"]
    assert set(kinds) == set(order)
    for i, kind in enumerate(order, 1):
        r.add(
            f"rm{i}_{kind.lower()}",
            lambda s, d, k=kind: rounded(rem(s, d).filter(F.col("remediation_type") == k)),
            f"WITH {REM} SELECT run_id, target_type, target_key, remediation_type, {r6('score', 'score')}, priority, confidence FROM rem WHERE remediation_type = '{kind}'",
        )

    def acted(s, d):
        x = rem(s, d)
        n = F.expr("cast(substring(run_id, 2) as int)")
        acts = x.select("run_id", "remediation_type", "target_key", F.explode(F.sequence(F.lit(0), n % 3)).alias("i"), n.alias("n")).select(
            "run_id", "remediation_type", "target_key", F.when((F.col("i") + F.col("n")) % 2 == 0, F.lit("SELECT")).otherwise(F.lit("REJECT")).alias("action"),
            F.timestamp_seconds(F.lit(1700000000) + F.col("i") * 60).alias("acted_at")).filter(F.col("n") % 4 != 0)
        return U.fold_actions(x, acts).groupBy("remediation_type", "status").agg(F.count(F.lit(1)).alias("n"))

    r.add(
        "rm12_fold_actions",
        acted,
        f"""WITH {REM}, z AS (SELECT remediation_type, substring(run_id, 2)::INT AS n FROM rem) SELECT remediation_type, CASE WHEN n % 4 = 0 THEN 'PROPOSED' WHEN (n % 3 + n) % 2 = 0 THEN 'SELECTED' ELSE 'REJECTED' END AS status,
        count(*) AS n FROM z GROUP BY 1, 2""",
    )
    r.add(
        "jn2_feature_evidence_join",
        lambda s, d: rounded(U.evidence_wide(norm(s, d)).filter("psi is not null and error_association is not null").groupBy("run_id").agg(
            F.count(F.lit(1)).alias("n"), F.max(F.col("psi") * F.col("error_association")).alias("strongest"))),
        f"WITH {WIDE} SELECT run_id, count(*) AS n, {r6('max(psi * assoc)', 'strongest')} FROM fw GROUP BY 1",
    )
