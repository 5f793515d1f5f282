"""Performance and calibration queries on the two scored views."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import performance as P
from plumbline.operators import predicates as R

from .common import SCORED_DOCS, SCORED_LINES, Registry, dbl, r6, rounded, score_cte, scored_docs, scored_lines, table

CELLS = """sum((p >= {t} AND y = 1)::INT)::BIGINT AS tp, sum((p >= {t} AND y <> 1)::INT)::BIGINT AS fp,
  sum((p < {t} AND y <> 1)::INT)::BIGINT AS tn, sum((p < {t} AND y = 1)::INT)::BIGINT AS fn"""


def rates(exact: bool = False) -> str:
    """Named rate expressions over tp, fp, tn, fn."""
    prec = "CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) WHEN tp + fn > 0 THEN 0 ELSE 1 END"
    rec = "CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END"
    exprs = {
        "accuracy": "(tp + tn)::DOUBLE / (tp + fp + tn + fn)",
        "precision": prec,
        "recall": rec,
        "specificity": "CASE WHEN tn + fp > 0 THEN tn::DOUBLE / (tn + fp) ELSE 0 END",
        "f1": f"CASE WHEN ({prec}) + ({rec}) > 0 THEN 2 * ({prec}) * ({rec}) / (({prec}) + ({rec})) ELSE 0 END",
        "fpr": "CASE WHEN fp + tn > 0 THEN fp::DOUBLE / (fp + tn) ELSE 0 END",
        "fnr": "CASE WHEN fn + tp > 0 THEN fn::DOUBLE / (fn + tp) ELSE 0 END",
        "predicted_positive_rate": "(tp + fp)::DOUBLE / (tp + fp + tn + fn)",
    }
    return ", ".join(f"({e})::DOUBLE AS {n}" if exact else r6(e, n) for n, e in exprs.items())


CLIP = f"least(greatest(p, {dbl(P.LOG_EPS)}), 1 - {dbl(P.LOG_EPS)})"
LOGLOSS = f"avg(-(CASE WHEN y = 1 THEN ln({CLIP}) ELSE ln(1 - ({CLIP})) END))"
BRIER = "avg((p - (y = 1)::INT) * (p - (y = 1)::INT))"
AUC = "sum(pos * (lt_neg + neg / 2)) / max(tp_all * tn_all)"
AP = "sum(pos * (tp_all - lt_pos) / ((tp_all - lt_pos) + (tn_all - lt_neg))) / max(tp_all)"
EDGES = "[" + ", ".join(dbl(e) for e in P.grid(11)) + "]"


def cal_sql(source: str = "scored", tag: str = "") -> str:
    """cal and ece, their names and those of their steps with ``tag``."""
    return f"""{tag}cb AS (SELECT least(len(list_filter({EDGES}, lambda e: e <= p)), 10) - 1 AS bin, count(*) AS n, avg(p) AS mp, avg((y = 1)::INT::DOUBLE) AS ob
  FROM {source} GROUP BY 1), {tag}sp AS (SELECT unnest(range(0, 10)) AS bin),
{tag}cal AS (SELECT bin, {EDGES}[bin + 1] AS lo, {EDGES}[bin + 2] AS hi, coalesce(n, 0) AS n, coalesce(mp, ({EDGES}[bin + 1] + {EDGES}[bin + 2]) / 2) AS mp,
  coalesce(ob, 0) AS ob, coalesce(mp - ob, 0) AS delta FROM {tag}sp LEFT JOIN {tag}cb USING (bin)),
{tag}ece AS (SELECT sum(n * abs(delta)) / sum(n) AS ece, max(abs(delta)) AS mce, sum(n * delta) / sum(n) AS signed FROM {tag}cal)"""


CAL = cal_sql()
TENDENCY = """CASE WHEN ece < 0.05 THEN 'WELL_CALIBRATED' WHEN signed > 0.03 THEN 'OVERCONFIDENT' WHEN signed < -0.03 THEN 'UNDERCONFIDENT' ELSE 'MIXED' END"""
PRIOR = """-(r * ln(r) + (1 - r) * ln(1 - r))"""


def grid_sql(points: list[float]) -> str:
    pts = "[" + ", ".join(dbl(e) for e in points) + "]"
    cells = CELLS.replace("{t}", "t")
    return f"""pts AS (SELECT unnest({pts}) AS t), cells AS (SELECT t, {cells} FROM pts CROSS JOIN
        (SELECT p, y, count(*) AS n FROM scored GROUP BY 1, 2) z GROUP BY 1)""".replace("::INT)::BIGINT", "::INT * n)::BIGINT")


def _bad(s, d):
    """Line items with invalid scores planted by key."""
    k = F.col("l_orderkey")
    p = F.when(k % 50 == 0, F.lit(float("nan"))).when(k % 51 == 0, F.lit(1.5)).when(k % 52 == 0, F.lit(None)).otherwise(F.col("p"))
    return scored_lines(s, d).withColumn("p", p).withColumn("y", F.when(k % 53 != 0, F.col("y")))


BAD = SCORED_LINES.replace("l_quantity / 50.0::DOUBLE AS p", """CASE WHEN l_orderkey % 50 = 0 THEN 'nan'::DOUBLE WHEN l_orderkey % 51 = 0 THEN 1.5
  WHEN l_orderkey % 52 = 0 THEN NULL ELSE l_quantity / 50.0::DOUBLE END AS p""").replace(
    "(l_returnflag = 'R')::INT AS y", "CASE WHEN l_orderkey % 53 <> 0 THEN (l_returnflag = 'R')::INT END AS y")
GOOD = "(p IS NOT NULL AND NOT isnan(p) AND p BETWEEN 0 AND 1)"


def register(r: Registry) -> None:
    r.add(
        "pr2_valid_pairs",
        lambda s, d: rounded(R.valid_pair_counts(_bad(s, d), "y", "p")),
        f"""WITH {BAD} SELECT count(*) AS n_rows, sum((NOT {GOOD})::INT)::BIGINT AS invalid_predictions, sum(({GOOD} AND y IS NOT NULL)::INT)::BIGINT AS valid_rows,
        {r6(f'sum((NOT {GOOD})::INT)::DOUBLE / count(*)', 'invalid_rate')} FROM scored""",
    )
    r.add(
        "pr3_fairness_rows",
        lambda s, d: rounded(R.fairness_row_counts(_bad(s, d), "y", "grp", "p")),
        f"""WITH {BAD}, k AS (SELECT count(*) AS n, sum((y IS NOT NULL AND grp IS NOT NULL AND p IS NOT NULL AND NOT isnan(p))::INT)::BIGINT AS k FROM scored)
        SELECT n AS n_rows, k AS kept_rows, n - k AS excluded_rows, {r6('(n - k)::DOUBLE / n', 'excluded_rate')} FROM k""",
    )
    r.add(
        "pr6_map_binary",
        lambda s, d: R.map_binary(table(s, d, "lineitem"), "l_linestatus").groupBy("l_linestatus", "y").agg(F.count(F.lit(1)).alias("n")),
        "SELECT l_linestatus, (l_linestatus = (SELECT max(l_linestatus) FROM lineitem))::INT AS y, count(*) AS n FROM lineitem GROUP BY 1, 2",
    )
    r.add(
        "pf1_prediction_audit",
        lambda s, d: rounded(P.prediction_audit(_bad(s, d), "y", "p")),
        f"""WITH {BAD}, a AS (SELECT count(*) AS n_rows, sum((NOT {GOOD})::INT)::BIGINT AS invalid_predictions, sum(({GOOD} AND y IS NOT NULL)::INT)::BIGINT AS valid_rows FROM scored)
        SELECT *, {r6('invalid_predictions::DOUBLE / n_rows', 'invalid_rate')}, CASE WHEN invalid_predictions::DOUBLE / n_rows > 0.05 THEN 'CRITICAL'
        WHEN invalid_predictions > 0 THEN 'HIGH' END AS severity FROM a""",
    )
    for view, cte, name in ((scored_docs, SCORED_DOCS, "documents"), (scored_lines, SCORED_LINES, "lines")):
        r.add(
            f"pf2_confusion_{name}",
            lambda s, d, v=view: rounded(P.confusion(v(s, d), "y", "p", 0.5)),
            f"WITH {cte}, c AS (SELECT {CELLS.replace('{t}', '0.5')} FROM scored) SELECT 0.5::DOUBLE AS threshold, tp, fp, tn, fn, {rates()} FROM c",
        )
        r.add(
            f"pf3_threshold_grid_{name}",
            lambda s, d, v=view: rounded(P.threshold_grid(v(s, d), "y", "p")),
            f"WITH {cte}, {grid_sql(P.grid(21))} SELECT round(t, 3) AS threshold, tp, fp, tn, fn, {rates()} FROM cells",
        )
        r.add(
            f"pf4_roc_auc_{name}",
            lambda s, d, v=view: rounded(P.roc_auc(v(s, d), "y", "p")),
            f"WITH {cte}, {score_cte()} SELECT {r6(AUC, 'roc_auc')} FROM cum",
        )
        r.add(
            f"pf5_average_precision_{name}",
            lambda s, d, v=view: rounded(P.average_precision(v(s, d), "y", "p")),
            f"WITH {cte}, {score_cte()} SELECT {r6(AP, 'average_precision')} FROM cum",
        )
        r.add(
            f"pf8_calibration_curve_{name}",
            lambda s, d, v=view: rounded(P.calibration_curve(v(s, d), "y", "p")),
            f"""WITH {cte}, {CAL} SELECT bin, round(lo, 2) AS lower, round(hi, 2) AS upper, n, {r6('mp', 'mean_p')}, {r6('ob', 'observed')},
            {r6('abs(delta)', 'abs_error')}, {r6('delta', 'delta')} FROM cal""",
        )
    r.add(
        "pf3_best_thresholds",
        lambda s, d: rounded(P.best_thresholds(P.threshold_grid(scored_docs(s, d), "y", "p"))),
        f"""WITH {SCORED_DOCS}, {grid_sql(P.grid(21))}, g AS (SELECT round(t, 3) AS threshold, {rates()},
        (coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) + coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0)) / 2 AS bal FROM cells), b AS (SELECT * FROM g)
        SELECT (SELECT threshold FROM b ORDER BY round(f1, 4) DESC, threshold LIMIT 1) AS best_f1_threshold, {r6('max(f1)', 'best_f1')},
        (SELECT threshold FROM b ORDER BY round(bal, 4) DESC, threshold LIMIT 1) AS best_balanced_threshold, {r6('max(bal)', 'best_balanced_accuracy')} FROM b""",
    )
    r.add("pf6_log_loss", lambda s, d: rounded(P.log_loss(scored_docs(s, d), "y", "p")), f"WITH {SCORED_DOCS} SELECT {r6(LOGLOSS, 'log_loss')} FROM scored")
    r.add("pf7_brier", lambda s, d: rounded(P.brier(scored_lines(s, d), "y", "p")), f"WITH {SCORED_LINES} SELECT {r6(BRIER, 'brier')} FROM scored")
    r.add(
        "pf8_calibration_summary",
        lambda s, d: rounded(P.calibration_summary(P.calibration_curve(scored_docs(s, d), "y", "p"))),
        f"WITH {SCORED_DOCS}, {CAL} SELECT {r6('ece', 'ece')}, {r6('mce', 'mce')}, {r6('signed', 'signed_error')}, {TENDENCY} AS tendency FROM ece",
    )
    prev = f"pv AS (SELECT avg((y = 1)::INT::DOUBLE) AS r, {LOGLOSS} AS ll, {BRIER} AS br FROM scored)"
    r.add(
        "pf9_prevalence_baseline",
        lambda s, d: rounded(P.prevalence_baseline(scored_docs(s, d), "y", "p")),
        f"""WITH {SCORED_DOCS}, {prev} SELECT {r6('r', 'positive_rate')}, {r6('ll', 'log_loss')}, {r6('br', 'brier')}, {r6(PRIOR, 'prior_log_loss')},
        {r6('r * (1 - r)', 'prior_brier')}, ll < {PRIOR} AND br < r * (1 - r) AS beats_prior FROM pv""",
    )
    met = lambda cte: f"""WITH {cte}, {score_cte()}, {CAL}, {prev}, au AS (SELECT {AUC} AS auc, {AP} AS ap FROM cum), cf AS (SELECT {CELLS.replace('{t}', '0.5')}, count(*) AS n FROM scored),
        met AS (SELECT n, tp + fn AS positives, r, tp, fp, tn, fn, auc, ap, ll, br, ece, mce, signed, {TENDENCY} AS tendency, {PRIOR} AS pl,
        ll < {PRIOR} AND br < r * (1 - r) AS beats_prior, {rates()} FROM cf, au, pv, ece)"""  # noqa: E731
    shown = f"""n, positives, {r6('r', 'positive_rate')}, tp, fp, tn, fn, accuracy, precision, recall, specificity, f1, fpr, fnr, predicted_positive_rate,
        {r6('auc', 'roc_auc')}, {r6('ap', 'average_precision')}, {r6('ll', 'log_loss')}, {r6('br', 'brier')}, {r6('ece', 'ece')}, {r6('mce', 'mce')},
        {r6('signed', 'signed_error')}, {r6('pl', 'prior_log_loss')}, {r6('r * (1 - r)', 'prior_brier')}, beats_prior, tendency"""
    r.add(
        "pf10_performance_metrics",
        lambda s, d: rounded(P.performance_metrics(scored_lines(s, d), "y", "p")),
        f"{met(SCORED_LINES)} SELECT {shown} FROM met",
    )
    found = """f AS (SELECT 'auc_critical' AS code, 'CRITICAL' AS severity FROM met WHERE auc < 0.6 UNION ALL SELECT 'auc_low', 'WARNING' FROM met WHERE auc >= 0.6 AND auc < 0.7
        UNION ALL SELECT 'fnr_high', 'HIGH' FROM met WHERE fnr >= 0.5 UNION ALL SELECT 'fnr_elevated', 'WARNING' FROM met WHERE fnr >= 0.3 AND fnr < 0.5
        UNION ALL SELECT 'fpr_high', 'HIGH' FROM met WHERE fpr >= 0.4 UNION ALL SELECT 'f1_low', 'HIGH' FROM met WHERE f1 < 0.3
        UNION ALL SELECT 'ece_high', 'HIGH' FROM met WHERE ece >= 0.1 UNION ALL SELECT 'ece_elevated', 'WARNING' FROM met WHERE ece >= 0.05 AND ece < 0.1
        UNION ALL SELECT 'below_prior', 'HIGH' FROM met WHERE NOT beats_prior)"""
    r.add(
        "pf10_performance_findings",
        lambda s, d: P.performance_findings(P.performance_metrics(scored_lines(s, d), "y", "p"), P.prediction_audit(scored_lines(s, d), "y", "p")).select("code", "severity"),
        f"{met(SCORED_LINES)}, {found} SELECT code, severity FROM f",
    )
    r.add(
        "pf10_performance_report",
        lambda s, d: rounded(P.performance_report(scored_docs(s, d), "y", "p").select("roc_auc", "ece", "n_findings", "n_critical", "health_score", "passed")),
        f"""{met(SCORED_DOCS)}, {found}, h AS (SELECT count(*) AS n_findings, coalesce(sum((severity = 'CRITICAL')::INT), 0)::BIGINT AS n_critical,
        greatest(0, 100 - coalesce(sum(CASE severity WHEN 'CRITICAL' THEN 25 ELSE 10 END), 0))::DOUBLE AS health_score FROM f)
        SELECT {r6('auc', 'roc_auc')}, {r6('ece', 'ece')}, n_findings, n_critical, health_score, health_score >= 70 AND n_critical = 0 AS passed FROM met, h""",
    )
