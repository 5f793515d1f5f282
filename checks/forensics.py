"""Error analysis queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import association as A
from plumbline.operators import forensics as E

from .common import SCORED_DOCS, SCORED_LINES, Registry, dbl, r6, rounded, scored_docs, scored_lines
from .fairness import _wilson
from .performance import CAL, grid_sql

NUM = ["l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
ET = """et AS (SELECT *, (p >= 0.5)::INT AS pred, (y <> (p >= 0.5)::INT)::INT AS err, CASE WHEN p >= 0.5 THEN p ELSE 1 - p END AS conf, abs(y - p) AS perr, abs(p - 0.5) AS margin,
  CASE WHEN y = 1 AND p >= 0.5 THEN 'TP' WHEN y = 0 AND p < 0.5 THEN 'TN' WHEN y = 0 THEN 'FP' ELSE 'FN' END AS kind FROM scored)"""
LINES, DOCS = f"{SCORED_LINES}, {ET}", f"{SCORED_DOCS}, {ET}"
TALL = "tall AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS x, kind, err, p, conf FROM et" for c in NUM) + ")"


def et_lines(s, d):
    return E.evaluation_table(scored_lines(s, d), "y", "p")


def et_docs(s, d):
    return E.evaluation_table(scored_docs(s, d), "y", "p")


def _sep(name: str, a: str, b: str) -> str:
    return f"""SELECT '{name}' AS comparison, feature, na AS n_error, nb AS n_correct, ma AS mean_error, mb AS mean_correct,
      CASE WHEN na >= 2 AND nb >= 2 THEN coalesce((ma - mb) / nullif(sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 0), 0) ELSE 0 END AS d FROM (
      SELECT feature, count(*) FILTER (kind = '{a}') AS na, count(*) FILTER (kind = '{b}') AS nb, avg(x) FILTER (kind = '{a}') AS ma, avg(x) FILTER (kind = '{b}') AS mb,
      var_samp(x) FILTER (kind = '{a}') AS va, var_samp(x) FILTER (kind = '{b}') AS vb FROM tall GROUP BY 1)"""


def _mwu(name: str, a: str, b: str) -> str:
    return f"""SELECT '{name}' AS comparison, feature, na, nb, u, greatest((abs(u - na * nb / 2) - 0.5) / sqrt(na * nb / 12 * (na + nb + 1 - t / ((na + nb) * (na + nb - 1)))), 0) AS z FROM (
      SELECT feature, sum(a) AS na, sum(b) AS nb, sum(a * (lt + b / 2)) AS u, sum(power(a + b, 3) - (a + b)) AS t FROM (
      SELECT feature, a, b, coalesce(sum(b) OVER (PARTITION BY feature ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lt FROM (
      SELECT feature, x, count(*) FILTER (kind = '{a}')::DOUBLE AS a, count(*) FILTER (kind = '{b}')::DOUBLE AS b FROM tall GROUP BY 1, 2)) GROUP BY 1)"""


def register(r: Registry) -> None:
    r.add(
        "ef1_evaluation_table",
        lambda s, d: rounded(et_docs(s, d).select("doc_id", F.col("_pred").alias("pred"), "is_error", "error_type", "confidence", "p_error", "margin")),
        f"""WITH {DOCS} SELECT doc_id, pred::BIGINT AS pred, err::BIGINT AS is_error, kind AS error_type, {r6('conf', 'confidence')}, {r6('perr', 'p_error')}, {r6('margin', 'margin')} FROM et""",
    )
    r.add(
        "ef2_error_distribution",
        lambda s, d: rounded(E.error_distribution(et_lines(s, d))),
        f"""WITH {LINES}, k AS (SELECT unnest(['TP', 'TN', 'FP', 'FN']) AS kind) SELECT k.kind AS error_type, count(et.kind) AS n,
        {r6('count(et.kind)::DOUBLE / sum(count(et.kind)) OVER ()', 'share')}, {r6('coalesce(avg(p), 0)', 'mean_p')} FROM k LEFT JOIN et USING (kind) GROUP BY 1""",
    )
    r.add(
        "ef3_confidence_errors",
        lambda s, d: rounded(E.confidence_errors(et_lines(s, d))),
        f"""WITH {LINES} SELECT count(*) AS n, sum(err)::BIGINT AS errors, {r6('avg(conf) FILTER (err = 1)', 'mean_confidence')}, {r6('max(conf) FILTER (err = 1)', 'max_confidence')},
        {r6('avg(conf) FILTER (err = 0)', 'mean_correct_confidence')}, count(*) FILTER (err = 1 AND conf >= 0.75) AS confident_errors,
        count(*) FILTER (err = 1 AND conf >= 0.5 AND conf < 0.6) AS band_low, count(*) FILTER (err = 1 AND conf >= 0.6 AND conf < 0.75) AS band_moderate,
        count(*) FILTER (err = 1 AND conf >= 0.75 AND conf < 0.9) AS band_high, count(*) FILTER (err = 1 AND conf >= 0.9) AS band_very_high,
        {r6('quantile_cont(conf, 0.5) FILTER (err = 1)', 'median_confidence')}, {r6('quantile_cont(conf, 0.9) FILTER (err = 1)', 'p90_confidence')},
        {r6('count(*) FILTER (err = 1 AND conf >= 0.75)::DOUBLE / count(*)', 'confident_rate')},
        {r6('count(*) FILTER (err = 1 AND conf >= 0.75)::DOUBLE / sum(err)', 'confident_share')} FROM et""",
    )
    sep = f"{_sep('FP_VS_TN', 'FP', 'TN')} UNION ALL {_sep('FN_VS_TP', 'FN', 'TP')}"
    r.add(
        "ef4_class_separation",
        lambda s, d: rounded(E.class_separation(et_lines(s, d), NUM)),
        f"""WITH {LINES}, {TALL}, z AS ({sep}) SELECT comparison, feature, n_error, n_correct, {r6('mean_error', 'mean_error')}, {r6('mean_correct', 'mean_correct')}, {r6('d', 'cohens_d')} FROM z""",
    )
    r.add(
        "ef5_mann_whitney",
        lambda s, d: rounded(E.mann_whitney(et_lines(s, d), NUM).drop("p")),
        f"""WITH {LINES}, {TALL}, z AS ({_mwu('FP_VS_TN', 'FP', 'TN')} UNION ALL {_mwu('FN_VS_TP', 'FN', 'TP')})
        SELECT comparison, feature, na::BIGINT AS n_error, nb::BIGINT AS n_correct, {r6('u', 'u')}, {r6('z', 'z')} FROM z""",
    )
    r.add("ef5_mann_whitney_p", lambda s, d: rounded(E.feature_separation(et_lines(s, d), NUM)))
    assoc = " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS n, corr({c}, err) AS rr FROM et" for c in NUM)
    r.add(
        "ef6_error_association",
        lambda s, d: rounded(E.error_association(et_lines(s, d), NUM).drop("p")),
        f"WITH {LINES}, a AS ({assoc}) SELECT feature, n, {r6('rr', 'r')}, {r6('abs(rr) * sqrt(n - 2) / sqrt(1 - rr * rr)', 't')} FROM a",
    )
    r.add("ef6_error_association_p", lambda s, d: rounded(A.fdr(E.error_association(et_lines(s, d), NUM), "p", [], "feature")))
    from .leakage import CELLS

    flags = [("ERROR", "err", "true"), ("FP_VS_TN", "pred", "y = 0"), ("FN_VS_TP", "1 - pred", "y = 1")]
    tall = " UNION ALL ".join(f"SELECT '{n}|{c}' AS feature, {c} AS a, ({e})::VARCHAR AS b FROM et WHERE {w}" for n, e, w in flags for c in ("lang", "source"))
    r.add(
        "ef7_error_association_categorical",
        lambda s, d: rounded(E.error_association_cat(et_docs(s, d), ["lang", "source"])),
        f"""WITH {DOCS}, tall AS ({tall}), {CELLS} SELECT split_part(feature, '|', 1) AS comparison, split_part(feature, '|', 2) AS feature, n, {r6('v', 'cramers_v')} FROM assoc""",
    )
    fr = ["l_extendedprice", "l_linenumber"]
    qs = ", ".join(f"{i}.0::DOUBLE / 5" for i in range(6))
    ranges = " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, e, levels, {c}::DOUBLE AS x, err, kind, p, conf FROM et, (SELECT list_sort(list_distinct(quantile_cont({c}::DOUBLE, [{qs}]))) AS e, count(DISTINCT {c}) AS levels FROM et) q""" for c in fr)
    r.add(
        "ef8_error_ranges",
        lambda s, d: rounded(E.error_ranges(et_lines(s, d), fr)),
        f"""WITH {LINES}, z AS ({ranges}), b AS (SELECT *, least(len(list_filter(e, lambda k: k <= x)) - 1, len(e) - 2) AS bin FROM z), o AS (SELECT avg(err) AS rate FROM et)
        SELECT feature, bin, {r6('e[bin + 1]', 'lower')}, {r6('e[bin + 2]', 'upper')}, count(*) AS n, sum(err)::BIGINT AS errors, {r6('avg(err)', 'error_rate')},
        count(*) FILTER (kind = 'FP') AS fp, count(*) FILTER (kind = 'FN') AS fn, {r6('avg(p)', 'mean_p')}, {r6('avg(conf)', 'mean_confidence')},
        avg(err) >= max(rate) * 1.35 AS is_enriched, count(*) < 30 AS is_small, (SELECT count(*) FROM et) >= 30 AND levels >= 5 AND len(e) >= 3 AS is_testable FROM b, o GROUP BY feature, bin, e, levels""",
    )
    r.add(
        "ef9_top_errors",
        lambda s, d: rounded(E.top_errors(et_docs(s, d), ["doc_id"])),
        f"""WITH {DOCS} SELECT doc_id, kind AS error_type, {r6('p', 'p')}, {r6('conf', 'confidence')}, {r6('perr', 'p_error')}, round(conf * 50 + margin * 30 + perr * 20, 2) AS priority
        FROM et WHERE err = 1 ORDER BY round(conf * 50 + margin * 30 + perr * 20, 2) DESC, doc_id LIMIT 50""",
    )
    r.add(
        "ef10_calibration_errors",
        lambda s, d: rounded(E.calibration_errors(et_docs(s, d))),
        f"""WITH {DOCS}, {CAL}, er AS (SELECT least(len(list_filter([{', '.join(dbl(e) for e in E.grid(11))}], lambda e: e <= p)), 10) - 1 AS bin, sum(err)::BIGINT AS errors FROM et GROUP BY 1)
        SELECT bin, n, {r6('mp', 'mean_p')}, {r6('ob', 'observed')}, {r6('abs(delta)', 'gap')}, errors, {r6('errors::DOUBLE / n', 'error_rate')}, abs(delta) >= 0.1 AND n >= 10 AS is_severe
        FROM cal JOIN er USING (bin)""",
    )
    points = [round(v, 2) for v in E.grid(21)]
    prec = "CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) WHEN t >= 0.99 THEN 1 ELSE 0 END"
    rec = "CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END"
    r.add(
        "ef_operating_points",
        lambda s, d: rounded(E.operating_points(et_lines(s, d))),
        f"""WITH {SCORED_LINES}, {grid_sql(points)} SELECT t AS threshold, tp, fp, tn, fn, {r6(prec, 'precision')}, {r6(rec, 'recall')},
        {r6(f'CASE WHEN ({prec}) + ({rec}) > 0 THEN 2 * ({prec}) * ({rec}) / (({prec}) + ({rec})) ELSE 0 END', 'f1')},
        {r6('CASE WHEN fp + tn > 0 THEN fp::DOUBLE / (fp + tn) ELSE 0 END', 'fpr')}, {r6('CASE WHEN fn + tp > 0 THEN fn::DOUBLE / (fn + tp) ELSE 0 END', 'fnr')} FROM cells""",
    )
    groups = """every AS (SELECT lang AS grp, count(*) AS n, sum(err)::BIGINT AS errors, count(*) FILTER (kind = 'FP') AS fp, count(*) FILTER (kind = 'FN') AS fn,
        count(*) FILTER (err = 1 AND conf >= 0.75) AS confident_errors FROM et GROUP BY 1),
        g AS (SELECT * FROM every WHERE n >= 5)"""
    r.add(
        "ef11_subgroup_errors",
        lambda s, d: rounded(E.subgroup_errors(et_docs(s, d), "lang")),
        f"""WITH {DOCS}, {groups} SELECT grp, n, errors, {r6('errors::DOUBLE / n', 'error_rate')}, fp, fn, confident_errors, {r6(_wilson('errors', 'n', 'low'), 'rate_low')},
        {r6(_wilson('errors', 'n', 'high'), 'rate_high')}, n < 5 AS is_small FROM every""",
    )
    r.add(
        "ef11_subgroup_disparity",
        lambda s, d: rounded(E.subgroup_disparity(E.subgroup_errors(et_docs(s, d), "lang"))),
        f"""WITH {DOCS}, {groups}, k AS (SELECT max(errors::DOUBLE / n) AS hi, min(errors::DOUBLE / n) AS lo FROM g)
        SELECT {r6('hi', 'max_rate')}, {r6('lo', 'min_rate')}, {r6('round(hi / CASE WHEN lo > 0 THEN lo ELSE 0.01 END, 2)', 'disparity')} FROM k""",
    )
    r.add(
        "ef12_forensics_findings",
        lambda s, d: rounded(E.forensics_findings(et_docs(s, d), ["n_chars", "toxic"], ["lang", "source"], "lang").select("feature", "code", "severity", "value")),
    )
    r.add(
        "ef12_forensics_report",
        lambda s, d: rounded(E.forensics_report(et_docs(s, d), E.forensics_findings(et_docs(s, d), attr="lang")).select("n", "errors", "error_rate", "n_findings", "health_score", "passed")),
        f"""WITH {DOCS}, {groups}, k AS (SELECT round(max(errors::DOUBLE / n) / CASE WHEN min(errors::DOUBLE / n) > 0 THEN min(errors::DOUBLE / n) ELSE 0.01 END, 2) AS disp FROM g),
        e AS (SELECT count(*) AS n, sum(err)::BIGINT AS errors, avg(err) AS er, avg((err = 1 AND conf >= 0.75)::INT::DOUBLE) AS hc FROM et)
        SELECT n, errors, {r6('er', 'error_rate')}, (hc >= 0.1)::BIGINT + (disp >= 1.5)::BIGINT AS n_findings,
        round(least(greatest(100 - er * 50 - CASE WHEN hc >= 0.2 THEN 30 WHEN hc >= 0.1 THEN 15 ELSE 0 END - CASE WHEN disp >= 1.5 THEN 20 ELSE 0 END, 0), 100), 1) AS health_score,
        round(least(greatest(100 - er * 50 - CASE WHEN hc >= 0.2 THEN 30 WHEN hc >= 0.1 THEN 15 ELSE 0 END - CASE WHEN disp >= 1.5 THEN 20 ELSE 0 END, 0), 100), 1) >= 60 AND er < 0.5 AS passed FROM e, k""",
    )
