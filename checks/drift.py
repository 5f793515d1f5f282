"""Drift queries: early against late line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import association as A
from plumbline.operators import drift as D

from .common import DRIFT_CATEGORICAL, DRIFT_NUMERIC, PAIR, Registry, line_pair, r6, rounded, union_cells

TWO = f"""{PAIR}, both_ AS (SELECT feature, value, 1 AS b, 0 AS e FROM ({union_cells('base', DRIFT_NUMERIC)}) UNION ALL
  SELECT feature, value, 0, 1 FROM ({union_cells('evalt', DRIFT_NUMERIC)})),
cnt AS (SELECT feature, value, sum(b)::DOUBLE AS nb, sum(e)::DOUBLE AS ne FROM both_ GROUP BY 1, 2),
cum AS (SELECT *, sum(nb) OVER w / sum(nb) OVER (PARTITION BY feature) AS f, sum(ne) OVER w / sum(ne) OVER (PARTITION BY feature) AS g,
  lead(value) OVER w AS nxt FROM cnt WINDOW w AS (PARTITION BY feature ORDER BY value)),
ks AS (SELECT feature, sum(nb) AS nb, sum(ne) AS ne, max(abs(f - g)) AS ks FROM cum GROUP BY 1),
ksp AS (SELECT *, CASE WHEN ks * ks * nb * ne / (nb + ne) < 0.04 THEN 1 ELSE least(greatest(list_sum(list_transform(range(1, 101),
  lambda k: (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * k * k * ks * ks * nb * ne / (nb + ne)))), 0), 1) END AS p FROM ks),
bq AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, stddev_pop(value) AS sd,
  list_sort(list_distinct(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM both_ WHERE b = 1 GROUP BY 1),
w1 AS (SELECT c.feature, sum(CASE WHEN nxt IS NULL THEN 0 ELSE abs(f - g) * (nxt - value) END) AS w FROM cum c GROUP BY 1),
bins AS (SELECT feature, unnest(range(0, greatest(len(edges) - 1, 1))) AS bin FROM bq),
hits AS (SELECT c.feature, len(list_filter(list_slice(edges, 2, len(edges) - 1), lambda x: x <= value)) AS bin, sum(nb) AS nb, sum(ne) AS ne
  FROM cnt c JOIN bq USING (feature) GROUP BY 1, 2),
psib AS (SELECT feature, bin, coalesce(nb, 0) AS nb, coalesce(ne, 0) AS ne, count(*) OVER w AS k, sum(nb) OVER w AS tb, sum(ne) OVER w AS te
  FROM bins LEFT JOIN hits USING (feature, bin) WINDOW w AS (PARTITION BY feature)),
psip AS (SELECT *, (nb + 1e-4) / (tb + 1e-4 * k) AS ex, (ne + 1e-4) / (te + 1e-4 * k) AS ac FROM psib),
psi AS (SELECT feature, count(*) AS n_bins, sum((ac - ex) * ln(ac / ex)) AS psi FROM psip GROUP BY 1)"""

CAT = f"""cboth AS (SELECT feature, value, 1 AS b, 0 AS e FROM ({union_cells('base', DRIFT_CATEGORICAL, 'VARCHAR')}) UNION ALL
  SELECT feature, value, 0, 1 FROM ({union_cells('evalt', DRIFT_CATEGORICAL, 'VARCHAR')})),
ccnt AS (SELECT feature, value, sum(b)::DOUBLE AS nb, sum(e)::DOUBLE AS ne FROM cboth GROUP BY 1, 2),
ctot AS (SELECT *, sum(nb) OVER w AS tb, sum(ne) OVER w AS te, count(*) OVER w AS k FROM ccnt WINDOW w AS (PARTITION BY feature)),
cpsi AS (SELECT feature, max(tb)::BIGINT AS n_base, max(te)::BIGINT AS n_eval, max(k) AS k,
  sum(((ne + 1e-4) / (te + k * 1e-4) - (nb + 1e-4) / (tb + k * 1e-4)) * ln(((ne + 1e-4) / (te + k * 1e-4)) / ((nb + 1e-4) / (tb + k * 1e-4)))) AS psi FROM ctot GROUP BY 1),
cexp AS (SELECT *, (nb + ne) / (tb + te) * tb AS eb, (nb + ne) / (tb + te) * te AS ee FROM ctot),
cchi AS (SELECT feature, max(k) - 1 AS dof, sum(CASE WHEN k = 2 THEN power(abs(nb - eb) - least(abs(nb - eb), 0.5), 2) / eb + power(abs(ne - ee) - least(abs(ne - ee), 0.5), 2) / ee
  ELSE power(nb - eb, 2) / eb + power(ne - ee, 2) / ee END) AS chi2 FROM cexp GROUP BY 1),
cp AS (SELECT *, CASE WHEN dof = 2 THEN exp(-chi2 / 2) END AS p FROM cchi)"""


def shifted(s, d):
    """Evaluation side with a moved price and a changed flag mix, so that every tier occurs."""
    b, e = line_pair(s, d)
    e = e.withColumn("l_extendedprice", F.col("l_extendedprice") * 1.5).withColumn("l_tax", F.col("l_tax") + 0.02)
    e = e.withColumn("l_returnflag", F.when(F.col("l_linenumber") <= 3, F.lit("R")).otherwise(F.col("l_returnflag")))
    return b, e


def register(r: Registry) -> None:
    def keep(s, d):
        b, e = line_pair(s, d)
        b = b.withColumnRenamed("l_discount", "l_rebate")
        return b, e.withColumn("l_tax", F.col("l_tax").cast("string"))

    r.add(
        "dr1_schema_drift",
        lambda s, d: D.schema_drift(*keep(s, d)),
        """SELECT * FROM (VALUES ('l_orderkey', 'NUMERIC', 'NUMERIC', 'COMMON', NULL), ('l_partkey', 'NUMERIC', 'NUMERIC', 'COMMON', NULL),
        ('l_suppkey', 'NUMERIC', 'NUMERIC', 'COMMON', NULL), ('l_linenumber', 'NUMERIC', 'NUMERIC', 'COMMON', NULL), ('l_quantity', 'NUMERIC', 'NUMERIC', 'COMMON', NULL),
        ('l_extendedprice', 'NUMERIC', 'NUMERIC', 'COMMON', NULL), ('l_returnflag', 'CATEGORICAL', 'CATEGORICAL', 'COMMON', NULL),
        ('l_linestatus', 'CATEGORICAL', 'CATEGORICAL', 'COMMON', NULL), ('l_shipdate', 'CATEGORICAL', 'CATEGORICAL', 'COMMON', NULL),
        ('l_rebate', 'NUMERIC', NULL, 'MISSING', 'CRITICAL'), ('l_discount', NULL, 'NUMERIC', 'NEW', 'INFO'),
        ('l_tax', 'NUMERIC', 'CATEGORICAL', 'TYPE_MISMATCH', 'HIGH')) v(feature, base_type, eval_type, status, severity)""",
    )
    r.add(
        "dr2_ks_2samp",
        lambda s, d: rounded(D.ks_2samp(*line_pair(s, d), DRIFT_NUMERIC)),
        f"WITH {TWO} SELECT feature, nb::BIGINT AS n_base, ne::BIGINT AS n_eval, {r6('ks', 'ks')}, {r6('p', 'ks_p')} FROM ksp",
    )
    r.add(
        "dr3_wasserstein",
        lambda s, d: rounded(D.wasserstein(*line_pair(s, d), DRIFT_NUMERIC)),
        f"""WITH {TWO} SELECT feature, {r6('w', 'wasserstein')}, {r6('CASE WHEN q3 > q1 THEN w / (q3 - q1) WHEN sd > 0 THEN w / sd END', 'wasserstein_scaled')},
        CASE WHEN q3 > q1 THEN 'IQR' WHEN sd > 0 THEN 'STD' ELSE 'NONE' END AS scaled_by FROM w1 JOIN bq USING (feature)""",
    )
    r.add(
        "dr4_numeric_psi",
        lambda s, d: rounded(D.numeric_psi(*line_pair(s, d), DRIFT_NUMERIC)),
        f"WITH {TWO} SELECT feature, n_bins, {r6('psi', 'psi')} FROM psi",
    )
    r.add(
        "dr4_numeric_psi_bins",
        lambda s, d: rounded(D.numeric_psi_bins(*line_pair(s, d), DRIFT_NUMERIC)),
        f"""WITH {TWO} SELECT feature, bin, nb::BIGINT AS n_base, ne::BIGINT AS n_eval, {r6('(ac - ex) * ln(ac / ex)', 'psi_part')} FROM psip""",
    )
    r.add(
        "dr5_categorical_psi",
        lambda s, d: rounded(D.categorical_psi(*line_pair(s, d), DRIFT_CATEGORICAL)),
        f"WITH {PAIR}, {CAT} SELECT feature, n_base, n_eval, k AS n_categories, {r6('psi', 'psi')} FROM cpsi",
    )
    r.add(
        "dr6_chi2_drift",
        lambda s, d: rounded(D.chi2_drift(*line_pair(s, d), DRIFT_CATEGORICAL).drop("chi2_p")),
        f"WITH {PAIR}, {CAT} SELECT feature, {r6('chi2', 'chi2')}, dof FROM cchi",
    )
    r.add(
        "dr6_chi2_p_two_dof",
        lambda s, d: rounded(D.chi2_drift(*line_pair(s, d), ["l_returnflag"])),
        f"WITH {PAIR}, {CAT} SELECT feature, {r6('chi2', 'chi2')}, dof, {r6('p', 'chi2_p')} FROM cp WHERE feature = 'l_returnflag'",
    )
    r.add(
        "dr7_bh_fdr",
        lambda s, d: rounded(A.fdr(D.ks_2samp(*line_pair(s, d), DRIFT_NUMERIC), "ks_p", [], "feature").select("feature", "ks_p", "p_adjusted")),
        f"""WITH {TWO}, rk AS (SELECT feature, p, row_number() OVER (ORDER BY p, feature) AS r, count(*) OVER () AS m FROM ksp)
        SELECT feature, {r6('p', 'ks_p')}, {r6('least(1, min(p * m / r) OVER (ORDER BY p DESC, feature DESC))', 'p_adjusted')} FROM rk""",
    )
    moved = TWO.replace(PAIR, PAIR.replace("SELECT * FROM lineitem WHERE l_shipdate >=", """SELECT * REPLACE (l_extendedprice * 1.5 AS l_extendedprice,
      l_tax + 0.02 AS l_tax, CASE WHEN l_linenumber <= 3 THEN 'R' ELSE l_returnflag END AS l_returnflag) FROM lineitem WHERE l_shipdate >="""))
    feats = f"""{moved}, {CAT}, allf AS (SELECT feature, 'NUMERIC' AS kind, ks, w, psi, p FROM ksp JOIN w1 USING (feature) JOIN psi USING (feature)
        UNION ALL SELECT feature, 'CATEGORICAL', NULL, NULL, psi, CASE WHEN chi2 > 20 THEN 0 ELSE NULL END FROM cpsi JOIN cchi USING (feature) WHERE feature = 'l_returnflag'),
        rk AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY p, feature) AS r, count(*) OVER (PARTITION BY kind) AS m FROM allf),
        adj AS (SELECT *, least(1, min(p * m / r) OVER (PARTITION BY kind ORDER BY p DESC, feature DESC)) AS pa FROM rk),
        mag AS (SELECT *, pa < 0.05 AS sig, CASE WHEN psi >= 0.25 OR coalesce(ks, 0) >= 0.2 THEN 'HIGH' WHEN psi >= 0.1 OR coalesce(ks, 0) >= 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS practical FROM adj),
        sev AS (SELECT *, CASE WHEN psi >= 0.4 OR (practical = 'HIGH' AND sig AND (coalesce(ks, 0) >= 0.35 OR psi >= 0.35)) THEN 'CRITICAL'
        WHEN practical = 'HIGH' OR (practical = 'MEDIUM' AND sig) THEN 'HIGH' WHEN practical = 'MEDIUM' OR sig THEN 'WARNING' ELSE 'LOW' END AS severity FROM mag)"""
    r.add(
        "dr8_drift_severity",
        lambda s, d: rounded(D.drift_features(*shifted(s, d), DRIFT_NUMERIC, ["l_returnflag"]).select(
            "feature", "kind", "ks", "wasserstein", "psi", "significant", "practical", "severity")),
        f"WITH {feats} SELECT feature, kind, {r6('ks', 'ks')}, {r6('w', 'wasserstein')}, {r6('psi', 'psi')}, sig AS significant, practical, severity FROM sev",
    )

    def report(s, d):
        b, e = shifted(s, d)
        b, e = b.select(*DRIFT_NUMERIC, "l_returnflag"), e.select(*DRIFT_NUMERIC, "l_returnflag")
        feats = D.drift_features(b, e, DRIFT_NUMERIC, ["l_returnflag"])
        return D.drift_report(feats, D.schema_drift(b, e))

    tier = lambda t: f"sum((severity = '{t}')::INT)::BIGINT"
    r.add(
        "dr9_drift_report",
        lambda s, d: rounded(report(s, d)),
        f"""WITH {feats}, agg AS (SELECT count(*) AS n, max(psi) AS mp, arg_max(feature, psi) AS mf, avg(w) AS mw, sum(sig::INT)::BIGINT AS ns,
        sum((practical = 'HIGH')::INT)::BIGINT AS np, {tier('CRITICAL')} AS c, {tier('HIGH')} AS h, {tier('WARNING')} AS m, {tier('LOW')} AS l,
        sum((severity = 'WARNING' AND sig)::INT)::BIGINT AS ws FROM sev)
        SELECT n AS n_features, {r6('mp', 'max_psi')}, mf AS max_psi_feature, {r6('mw', 'mean_wasserstein')}, ns AS n_significant, np AS n_practical,
        c AS n_drift_critical, h AS n_drift_high, m AS n_drift_medium, l AS n_drift_low, 0::BIGINT AS n_untestable, c + h + ws AS n_findings, c AS n_critical,
        greatest(0, 100 - 20 * c - 8 * (h + ws))::DOUBLE AS health_score, greatest(0, 100 - 20 * c - 8 * (h + ws)) >= 70 AND c = 0 AS passed FROM agg""",
    )
    r.add(
        "st1_category_union",
        lambda s, d: D.category_counts(*shifted(s, d), ["l_returnflag"]),
        f"""WITH {moved}, {CAT} SELECT feature, value, nb::BIGINT AS n_base, ne::BIGINT AS n_eval FROM ccnt WHERE feature = 'l_returnflag'""",
    )
