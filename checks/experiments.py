"""Counterfactual transforms and paired tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import experiments as E
from plumbline.operators import isotonic as I

from .common import SCORED_DOCS, SCORED_LINES, Registry, r6, rounded, scored_docs, scored_lines, table
from .models import KEY
from .performance import BRIER, CELLS, cal_sql, grid_sql, rates


def _stats(df, c):
    return rounded(df.agg(F.count(c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.avg(c).alias("mean")))


def _sql(expr: str, src: str) -> str:
    return f"SELECT count(x) AS n, {r6('min(x)', 'lo')}, {r6('max(x)', 'hi')}, {r6('avg(x)', 'mean')} FROM (SELECT {expr} AS x FROM {src})"


def pair(s, d):
    """Two predictions per scored document: threshold .50 and .40, and a shifted probability."""
    p = F.col("p")
    return scored_docs(s, d).select("doc_id", "lang", "y", "p", (p >= 0.5).cast("int").alias("b"), (p >= 0.4).cast("int").alias("c"),
                                    F.when(F.col("n_chars") % 2 == 0, p * 0.9).otherwise(p).alias("p2"))


PAIR_SQL = f"""{SCORED_DOCS}, pr AS (SELECT doc_id, lang, y, p, (p >= 0.5)::INT AS b, (p >= 0.4)::INT AS c,
  CASE WHEN n_chars % 2 = 0 THEN p * 0.9::DOUBLE ELSE p END AS p2 FROM scored)"""


def isotonic_sql(source: str) -> str:
    """iso(x, m, w): at each score the greatest, over starts before it, of the least mean, over ends after it."""
    return f"""points AS (SELECT p AS x, sum(y)::DOUBLE AS t, count(*)::DOUBLE AS w, row_number() OVER (ORDER BY p) AS i FROM {source} GROUP BY p),
sums AS (SELECT *, sum(t) OVER (ORDER BY i) AS ct, sum(w) OVER (ORDER BY i) AS cw FROM points),
spans AS (SELECT a.i AS j, b.i AS k, (b.ct - a.ct + a.t) / (b.cw - a.cw + a.w) AS mean FROM sums a JOIN sums b ON b.i >= a.i),
least_after AS (SELECT j, k AS i, min(mean) OVER (PARTITION BY j ORDER BY k DESC) AS low FROM spans),
iso AS (SELECT x, w, m FROM points JOIN (SELECT i, max(low) AS m FROM least_after GROUP BY i) USING (i))"""


def register(r: Registry) -> None:
    li = lambda s, d: table(s, d, "lineitem")
    r.add("ex1_ablate_median", lambda s, d: _stats(E.ablate(li(s, d), "l_extendedprice", "median"), "l_extendedprice"),
          _sql("(SELECT quantile_cont(l_extendedprice, 0.5) FROM lineitem)", "lineitem"))
    r.add("ex1_ablate_zero", lambda s, d: _stats(E.ablate(li(s, d), "l_quantity", "zero"), "l_quantity"), _sql("0.0::DOUBLE", "lineitem"))
    r.add(
        "ex1_ablate_mode",
        lambda s, d: E.ablate(li(s, d), "l_returnflag", "median").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")),
        "SELECT (SELECT l_returnflag FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS l_returnflag, count(*) AS n FROM lineitem",
    )
    r.add(
        "ex2_clip",
        lambda s, d: rounded(E.clip(li(s, d), "l_extendedprice", 0.05, 0.95, "moved").agg(
            F.count_if("moved").alias("moved"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))),
        f"""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.05) AS a, quantile_cont(l_extendedprice, 0.95) AS b FROM lineitem)
        SELECT sum((l_extendedprice < a OR l_extendedprice > b)::INT)::BIGINT AS moved, {r6('max(a)', 'lo')}, {r6('max(b)', 'hi')} FROM lineitem, q""",
    )
    holes = lambda s, d: li(s, d).withColumn("l_tax", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_tax")))
    hole_src = "(SELECT CASE WHEN l_orderkey % 5 <> 0 THEN l_tax END AS l_tax FROM lineitem) h"
    for how, agg in (("mean", "avg(l_tax)"), ("median", "quantile_cont(l_tax, 0.5)")):
        r.add(f"ex3_fill_{how}", lambda s, d, h=how: _stats(E.fill_missing(holes(s, d), "l_tax", h), "l_tax"),
              _sql(f"coalesce(l_tax, (SELECT {agg} FROM {hole_src.replace(' h', ' g')}))", hole_src))
    r.add("ex4_standardize", lambda s, d: _stats(E.standardize(li(s, d), "l_quantity"), "l_quantity"),
          _sql("(l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_samp(l_quantity) FROM lineitem)", "lineitem"))
    r.add("ex5_inject_missing", lambda s, d: E.inject_missing(li(s, d), "l_tax", 0.2, 42, KEY).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_tax").isNull()).alias("missing")),
        f"""SELECT count(*) AS n, count(*) FILTER (('0x' || substr(md5(concat_ws('|', '42', 'l_tax', {', '.join(KEY)})), 1, 13))::BIGINT / {16**13}.0::DOUBLE < 0.2) AS missing FROM lineitem""")
    cells = """count(*) AS n, sum((y = 1)::INT)::BIGINT AS positives, sum((b <> c)::INT)::BIGINT AS changed, sum((b = 0 AND c = 0)::INT)::BIGINT AS n00,
        sum((b = 0 AND c = 1)::INT)::BIGINT AS n01, sum((b = 1 AND c = 0)::INT)::BIGINT AS n10, sum((b = 1 AND c = 1)::INT)::BIGINT AS n11"""
    r.add(
        "ex6_paired_comparison",
        lambda s, d: rounded(E.paired_comparison(pair(s, d), "y", "b", "c").drop("mcnemar_p")),
        f"""WITH {PAIR_SQL}, k AS (SELECT {cells} FROM pr) SELECT *, {r6('changed::DOUBLE / n', 'flip_rate')},
        {r6('CASE WHEN n01 + n10 > 0 THEN power(greatest(abs(n01 - n10) - 1, 0), 2)::DOUBLE / (n01 + n10) ELSE 0 END', 'mcnemar')} FROM k""",
    )
    r.add("ex6_mcnemar_p", lambda s, d: rounded(E.paired_comparison(pair(s, d), "y", "b", "c").select("mcnemar", "mcnemar_p")))
    r.add(
        "ex7_shift_summary",
        lambda s, d: rounded(E.shift_summary(pair(s, d), "p", "p2")),
        f"""WITH {PAIR_SQL} SELECT count(*) AS n, {r6('avg(p2 - p)', 'mean_shift')}, {r6('avg(abs(p2 - p))', 'mean_abs_shift')},
        {r6('quantile_cont(p2 - p, 0.5)', 'median_shift')} FROM pr""",
    )
    r.add("ex7_shift_ci", lambda s, d: rounded(E.shift_ci(pair(s, d), "p", "p2", ["doc_id"], 500)))
    names = ("accuracy", "precision", "recall", "f1", "fpr", "fnr")
    side = lambda t, a: f"{a} AS (SELECT {rates(True)} FROM (SELECT {CELLS.replace('{t}', t)} FROM scored) z)"
    r.add(
        "ex8_threshold_counterfactual",
        lambda s, d: rounded(E.threshold_counterfactual(scored_docs(s, d), "y", "p", 0.5, 0.4), 5),
        f"""WITH {SCORED_DOCS}, {side('0.5', 'a')}, {side('0.4::DOUBLE', 'b')} """ + " UNION ALL ".join(
            f"SELECT '{n}' AS metric, round(a.{n} + 2e-9, 5) + 0.0 AS baseline, round(b.{n} + 2e-9, 5) + 0.0 AS candidate, round(b.{n} - a.{n} + 2e-9, 5) + 0.0 AS delta FROM a, b" for n in names),
    )
    r.add(
        "ex8_threshold_curve",
        lambda s, d: rounded(E.threshold_curve(scored_docs(s, d), "y", "p").select("threshold", "tp", "fp", "tn", "fn")),
        f"WITH {SCORED_DOCS}, {grid_sql(__import__('plumbline.operators.performance', fromlist=['grid']).grid(21))} SELECT round(t, 3) AS threshold, tp, fp, tn, fn FROM cells",
    )
    even = lambda s, d: (scored_docs(s, d).filter("doc_id % 2 = 0"), scored_docs(s, d).filter("doc_id % 2 = 1"))
    r.add("ex9_calibration_platt", lambda s, d: rounded(E.calibration_counterfactual(*even(s, d), "y", "p", "PLATT"), 4))
    r.add(
        "ex9_calibration_isotonic",
        lambda s, d: rounded(E.calibration_counterfactual(*even(s, d), "y", "p", "ISOTONIC"), 4),
        f"""WITH {SCORED_DOCS}, calib AS (SELECT * FROM scored WHERE doc_id % 2 = 1), {isotonic_sql('calib')}, held AS (SELECT * FROM scored WHERE doc_id % 2 = 0),
        lower_end AS (SELECT h.doc_id, x, m FROM held h ASOF LEFT JOIN iso ON h.p >= iso.x), upper_end AS (SELECT h.doc_id, x, m FROM held h ASOF LEFT JOIN iso ON h.p <= iso.x),
        fitted AS (SELECT h.doc_id, h.y, CASE WHEN l.x IS NULL THEN u.m WHEN u.x IS NULL OR l.x = u.x THEN l.m ELSE l.m + (u.m - l.m) * (h.p - l.x) / (u.x - l.x) END AS p
          FROM held h JOIN lower_end l USING (doc_id) JOIN upper_end u USING (doc_id)),
        {cal_sql('held', 'held_')}, {cal_sql('fitted', 'fitted_')}, b AS (SELECT {BRIER} AS v FROM held), a AS (SELECT {BRIER} AS v FROM fitted)
        SELECT 'ISOTONIC' AS method, {r6('e0.ece', 'baseline_ece', 4)}, {r6('e1.ece', 'candidate_ece', 4)}, {r6('e1.ece - e0.ece', 'ece_delta', 4)}, {r6('b.v', 'baseline_brier', 4)},
        {r6('a.v', 'candidate_brier', 4)}, {r6('a.v - b.v', 'brier_delta', 4)} FROM held_ece e0, fitted_ece e1, a, b""",
    )
    r.add(
        "ex9_isotonic_blocks",
        lambda s, d: rounded(I.isotonic_blocks(scored_docs(s, d), "y", "p", slice_rows=64)),
        f"""WITH {SCORED_DOCS}, {isotonic_sql('scored')} SELECT {r6('min(x)', 'lo')}, {r6('max(x)', 'hi')}, {r6('m', 'mean')}, sum(w)::DOUBLE AS weight FROM (SELECT x, w, round(m, 12) AS m FROM iso) GROUP BY m""",
    )
    r.add(
        "ex9_isotonic_blocks_lines",
        lambda s, d: rounded(I.isotonic_blocks(scored_lines(s, d).withColumn("q", 1 - F.col("p")), "y", "q")),
        f"""WITH {SCORED_LINES}, turned AS (SELECT 1 - p AS p, y FROM scored), {isotonic_sql('turned')} SELECT {r6('min(x)', 'lo')}, {r6('max(x)', 'hi')}, {r6('m', 'mean')}, sum(w)::DOUBLE AS weight
        FROM (SELECT x, w, round(m, 12) AS m FROM iso) GROUP BY m""",
    )
    f1 = lambda k: f"CASE WHEN 2 * sum(({k} = 1 AND y = 1)::INT) + sum(({k} <> y)::INT) > 0 THEN 2.0::DOUBLE * sum(({k} = 1 AND y = 1)::INT) / (2 * sum(({k} = 1 AND y = 1)::INT) + sum(({k} <> y)::INT)) ELSE 0 END"
    acc = lambda k: f"avg(({k} = y)::INT::DOUBLE)"
    r.add(
        "ex10_subgroup_counterfactual",
        lambda s, d: rounded(E.subgroup_counterfactual(pair(s, d), "lang", "y", "b", "c")),
        f"""WITH {PAIR_SQL} SELECT lang AS grp, count(*) AS n, sum((b <> c)::INT)::BIGINT AS flips, {r6('avg((b <> c)::INT::DOUBLE)', 'flip_rate')}, {r6(acc('b'), 'baseline_accuracy')},
        {r6(acc('c'), 'candidate_accuracy')}, {r6(f"{acc('c')} - {acc('b')}", 'accuracy_delta')}, {r6(f1('b'), 'baseline_f1')}, {r6(f1('c'), 'candidate_f1')},
        {r6(f"({f1('c')}) - ({f1('b')})", 'f1_delta')} FROM pr GROUP BY 1""",
    )
    crit = [("ACCEPT", "fnr", "DELTA_LT", 0.0), ("ACCEPT", "f1", "DELTA_GE", -0.01), ("GUARD", "accuracy", "DELTA_GE", -0.02), ("GUARD", "fpr", "DELTA_LE", 0.3)]

    def deltas(s, d):
        return E.threshold_counterfactual(scored_docs(s, d), "y", "p", 0.5, 0.4)

    vals = ", ".join(f"('{k}', '{m}', '{t}', {b}::DOUBLE)" for k, m, t, b in crit)
    judged = f"""{SCORED_DOCS}, {side('0.5', 'a')}, {side('0.4::DOUBLE', 'b')}, dl AS ({" UNION ALL ".join(f"SELECT '{n}' AS metric, b.{n} AS v, b.{n} - a.{n} AS d FROM a, b" for n in names)}),
        cr(kind, metric, test, bound) AS (VALUES {vals}), j AS (SELECT kind, metric, test, CASE test WHEN 'DELTA_LT' THEN d < bound WHEN 'DELTA_GE' THEN d >= bound ELSE d <= bound END AS passed FROM cr LEFT JOIN dl USING (metric))"""
    r.add(
        "ex11_judge_criteria",
        lambda s, d: E.judge_criteria(deltas(s, d), E.criteria_table(s, crit)).select("kind", "metric", "test", "passed"),
        f"WITH {judged} SELECT kind, metric, test, passed FROM j",
    )
    r.add(
        "ex11_evaluate_acceptance",
        lambda s, d: E.evaluate_acceptance(deltas(s, d), E.criteria_table(s, crit)),
        f"""WITH {judged}, k AS (SELECT sum((kind = 'ACCEPT')::INT)::BIGINT AS criteria, sum((kind = 'ACCEPT' AND passed)::INT)::BIGINT AS criteria_passed,
        sum((passed IS NULL)::INT)::BIGINT AS unmeasured, sum((kind = 'GUARD' AND NOT passed)::INT)::BIGINT AS guards_failed FROM j)
        SELECT *, CASE WHEN guards_failed > 0 THEN 'REJECTED' WHEN unmeasured > 0 THEN 'INCONCLUSIVE' WHEN criteria_passed = criteria THEN 'VALIDATED'
        WHEN criteria_passed > 0 THEN 'PARTIALLY_VALIDATED' ELSE 'REJECTED' END AS conclusion FROM k""",
    )
