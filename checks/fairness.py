"""Fairness queries: languages of scored documents, and line status."""

from __future__ import annotations

from plumbline.operators import fairness as G

from .common import SCORED_DOCS, SCORED_LINES, Registry, r6, rounded, scored_docs, scored_lines

Z = "1.95996::DOUBLE"


def _wilson(k: str, n: str, side: str) -> str:
    centre = f"(({k})::DOUBLE / ({n}) + {Z} * {Z} / (2.0::DOUBLE * ({n}))) / (1 + {Z} * {Z} / ({n}))"
    spread = f"{Z} * sqrt(({k})::DOUBLE / ({n}) * (1 - ({k})::DOUBLE / ({n})) / ({n}) + {Z} * {Z} / (4.0::DOUBLE * ({n}) * ({n}))) / (1 + {Z} * {Z} / ({n}))"
    if side == "low":
        return f"CASE WHEN ({n}) > 0 THEN greatest({centre} - {spread}, 0) ELSE 0 END"
    return f"CASE WHEN ({n}) > 0 THEN least({centre} + {spread}, 1) ELSE 0 END"


def gm(cte: str, grp: str) -> str:
    div = lambda a, b: f"CASE WHEN ({b}) > 0 THEN ({a})::DOUBLE / ({b}) END"
    return f"""{cte}, cells AS (SELECT {grp} AS grp, count(*) AS n, sum((p >= 0.5 AND y = 1)::INT)::BIGINT AS tp, sum((p >= 0.5 AND y <> 1)::INT)::BIGINT AS fp,
      sum((p < 0.5 AND y <> 1)::INT)::BIGINT AS tn, sum((p < 0.5 AND y = 1)::INT)::BIGINT AS fn, avg(p) AS mean_p FROM scored GROUP BY 1),
    gm AS (SELECT *, (tp + fp)::DOUBLE / n AS sel, (tp + fn)::DOUBLE / n AS base, {div('tp', 'tp + fn')} AS tpr, {div('fp', 'tn + fp')} AS fpr FROM cells),
    ref AS (SELECT grp AS rg, sel AS rs, tpr AS rt, fpr AS rf FROM gm ORDER BY n DESC, grp LIMIT 1),
    cmp AS (SELECT gm.*, ref.*, CASE WHEN rs > 0 THEN sel / rs END AS dir FROM gm, ref),
    summ AS (SELECT count(*) AS n_groups, sum(n)::BIGINT AS n_rows, sum((n < 30)::INT)::BIGINT AS small_groups, max(rg) AS reference, max(sel) - min(sel) AS dp,
      coalesce(max(tpr) - min(tpr), 0) AS tg, coalesce(max(fpr) - min(fpr), 0) AS fg, max(abs(mean_p - base)) AS cg,
      coalesce(min(CASE WHEN grp <> rg AND dir < 1 THEN dir END), 1) AS wd,
      coalesce((SELECT grp FROM cmp WHERE grp <> rg AND dir < 1 ORDER BY dir, grp LIMIT 1), max(rg)) AS wg FROM cmp)"""


def register(r: Registry) -> None:
    div = lambda a, b: f"CASE WHEN ({b}) > 0 THEN ({a})::DOUBLE / ({b}) END"
    docs, lines = gm(SCORED_DOCS, "lang"), gm(SCORED_LINES, "grp")
    metrics_sql = f"""n, tp, fp, tn, fn, {r6('sel', 'selection_rate')}, {r6('base', 'base_rate')}, {r6('tpr', 'tpr')}, {r6(div('fn', 'tp + fn'), 'fnr')}, {r6(div('tn', 'tn + fp'), 'tnr')},
        {r6('fpr', 'fpr')}, {r6(div('tp', 'tp + fp'), 'ppv')}, {r6(div('tn', 'tn + fn'), 'npv')}, {r6('(tp + tn)::DOUBLE / n', 'accuracy')}, {r6('mean_p', 'mean_p')}, n < 30 AS is_small,
        {r6(_wilson('tp + fp', 'n', 'low'), 'selection_low')}, {r6(_wilson('tp + fp', 'n', 'high'), 'selection_high')},
        {r6(_wilson('tp', 'tp + fn', 'low'), 'tpr_low')}, {r6(_wilson('tp', 'tp + fn', 'high'), 'tpr_high')},
        {r6(_wilson('fp', 'fp + tn', 'low'), 'fpr_low')}, {r6(_wilson('fp', 'fp + tn', 'high'), 'fpr_high')}"""
    g_docs = lambda s, d: G.group_metrics(scored_docs(s, d), "y", "p", "lang")
    g_lines = lambda s, d: G.group_metrics(scored_lines(s, d), "y", "p", "grp")
    r.add("fr1_group_metrics_documents", lambda s, d: rounded(g_docs(s, d)), f"WITH {docs} SELECT grp, {metrics_sql} FROM gm")
    r.add("fr1_group_metrics_lines", lambda s, d: rounded(g_lines(s, d)), f"WITH {lines} SELECT grp, {metrics_sql} FROM gm")
    r.add(
        "fr2_wilson",
        lambda s, d: rounded(g_lines(s, d).select("grp", "selection_low", "selection_high")),
        f"WITH {lines} SELECT grp, {r6(_wilson('tp + fp', 'n', 'low'), 'selection_low')}, {r6(_wilson('tp + fp', 'n', 'high'), 'selection_high')} FROM gm",
    )
    r.add(
        "fr3_reference_group",
        lambda s, d: rounded(G.reference_group(g_docs(s, d))),
        f"WITH {docs} SELECT rg AS ref_grp, {r6('rs', 'ref_selection')}, {r6('rt', 'ref_tpr')}, {r6('rf', 'ref_fpr')} FROM ref",
    )
    r.add(
        "fr4_demographic_parity",
        lambda s, d: rounded(G.demographic_parity(g_docs(s, d))),
        f"WITH {docs} SELECT grp, {r6('sel', 'selection_rate')}, {r6('rs', 'reference_rate')}, {r6('sel - rs', 'difference')}, {r6('abs(sel - rs)', 'gap')} FROM cmp",
    )
    r.add(
        "fr5_disparate_impact",
        lambda s, d: rounded(G.disparate_impact(g_docs(s, d))),
        f"WITH {docs} SELECT grp, grp = rg AS is_reference, {r6('dir', 'impact_ratio')}, coalesce(dir < 0.8 OR dir > 1.25, false) AS violates_rule FROM cmp",
    )
    r.add(
        "fr6_equalized_odds",
        lambda s, d: rounded(G.equalized_odds(g_docs(s, d))),
        f"""WITH {docs} SELECT grp, {r6('tpr - rt', 'tpr_difference')}, {r6('abs(tpr - rt)', 'tpr_gap')}, {r6('fpr - rf', 'fpr_difference')},
        {r6('abs(fpr - rf)', 'fpr_gap')} FROM cmp""",
    )
    r.add(
        "fr7_group_calibration",
        lambda s, d: rounded(G.group_calibration(g_docs(s, d))),
        f"WITH {docs} SELECT grp, {r6('mean_p', 'mean_p')}, {r6('base', 'base_rate')}, {r6('mean_p - base', 'calibration_gap')}, {r6('abs(mean_p - base)', 'absolute_gap')} FROM gm",
    )
    r.add(
        "fr8_worst_groups",
        lambda s, d: G.worst_groups(g_docs(s, d)),
        f"""WITH {docs} SELECT (SELECT grp FROM gm ORDER BY sel, grp LIMIT 1) AS lowest_selection,
        (SELECT grp FROM gm WHERE tpr IS NOT NULL ORDER BY tpr, grp LIMIT 1) AS lowest_tpr,
        (SELECT grp FROM gm WHERE fpr IS NOT NULL ORDER BY fpr DESC, grp LIMIT 1) AS highest_fpr, (SELECT wg FROM summ) AS worst_impact""",
    )
    r.add(
        "fr9_fairness_guards",
        lambda s, d: G.fairness_guards(scored_docs(s, d), "y", "p", "source"),
        f"""WITH {SCORED_DOCS}, g AS (SELECT source, count(*) AS n, min(p) AS lo, max(p) AS hi, sum((p > 0 AND p < 1)::INT) AS inn FROM scored GROUP BY 1),
        a AS (SELECT count(*) AS n_groups, sum(n)::BIGINT AS n_rows, sum((n < 30)::INT)::BIGINT AS small_groups, min(lo) >= 0 AND max(hi) <= 1 AND sum(inn) > 0 AS has_probabilities FROM g)
        SELECT *, CASE WHEN n_rows < 2 THEN 'TOO_FEW_ROWS' WHEN n_groups < 2 THEN 'SINGLE_GROUP' WHEN n_groups > 50 THEN 'TOO_MANY_GROUPS'
        WHEN n_groups > 20 THEN 'MANY_GROUPS' ELSE 'OK' END AS status FROM a""",
    )
    summ_sql = f"""n_groups, n_rows, small_groups, reference, {r6('dp', 'dp_gap')}, {r6('tg', 'tpr_gap')}, {r6('fg', 'fpr_gap')}, {r6('greatest(tg, fg)', 'odds_gap')},
        {r6('cg', 'calibration_gap')}, {r6('wd', 'worst_impact_ratio')}, wg AS worst_impact_group"""
    r.add("fr10_fairness_summary", lambda s, d: rounded(G.fairness_summary(g_docs(s, d))), f"WITH {docs} SELECT {summ_sql} FROM summ")
    found = f"""f AS (SELECT grp AS feature, 'impact_critical' AS code, 'HIGH' AS severity, dir AS value FROM cmp WHERE grp <> rg AND dir < 0.7
        UNION ALL SELECT grp, 'impact_low', 'WARNING', dir FROM cmp WHERE grp <> rg AND dir >= 0.7 AND dir < 0.8
        UNION ALL SELECT grp, 'impact_high', 'HIGH', dir FROM cmp WHERE grp <> rg AND dir > 1.43
        UNION ALL SELECT NULL, 'parity_critical', 'HIGH', dp FROM summ WHERE dp >= 0.2 UNION ALL SELECT NULL, 'parity_elevated', 'WARNING', dp FROM summ WHERE dp >= 0.1 AND dp < 0.2
        UNION ALL SELECT NULL, 'opportunity_critical', 'HIGH', tg FROM summ WHERE tg >= 0.1 UNION ALL SELECT NULL, 'opportunity_elevated', 'WARNING', tg FROM summ WHERE tg >= 0.05 AND tg < 0.1
        UNION ALL SELECT NULL, 'odds_critical', 'HIGH', fg FROM summ WHERE fg >= 0.1 UNION ALL SELECT NULL, 'small_groups', 'WARNING', small_groups FROM summ WHERE small_groups > 0
        UNION ALL SELECT NULL, 'calibration_gap', 'WARNING', cg FROM summ WHERE cg >= 0.1)"""
    r.add(
        "fr10_fairness_findings",
        lambda s, d: rounded(G.fairness_findings(g_docs(s, d)).select("feature", "code", "severity", "value")),
        f"WITH {docs}, {found} SELECT feature, code, severity, {r6('value', 'value')} FROM f",
    )
    r.add(
        "fr10_fairness_report",
        lambda s, d: rounded(G.fairness_report(scored_docs(s, d), "y", "p", "lang")),
        f"""WITH {docs}, {found}, h AS (SELECT count(*) AS n_findings, 0::BIGINT AS n_critical, greatest(0, 100 - sum(CASE severity WHEN 'HIGH' THEN 15 ELSE 5 END))::DOUBLE AS health_score FROM f)
        SELECT {summ_sql}, n_findings, n_critical, health_score, health_score >= 70 AND wd >= 0.7 AS passed FROM summ, h""",
    )
