"""Model-in-the-loop queries: a fixed logistic model over line items."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import explain as X
from plumbline.operators import robustness as B
from plumbline.operators import scoring as S
from plumbline.operators import trees as R

from .common import Registry, dbl, r6, rounded, table

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
COEF = {"l_quantity": 0.08, "l_extendedprice": -0.00002, "l_discount": 6.0, "l_tax": -4.0}
INTERCEPT = -1.2
MODEL = S.LinearModel(COEF, INTERCEPT)
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def lines(s, d):
    return table(s, d, "lineitem").select(*KEY, *FEATURES, "l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("y"))


def z(changes: dict[str, str] | None = None) -> str:
    parts = [dbl(INTERCEPT)] + [f"({(changes or {}).get(f, f)}) * {dbl(w)}" for f, w in COEF.items()]
    return f"1 / (1 + exp(-({' + '.join(parts)})))"


def by_hand(pdf):
    """The same model as a Python function, to exercise the Arrow path."""
    m = INTERCEPT + sum(pdf[f].to_numpy() * w for f, w in COEF.items())
    return 1 / (1 + np.exp(-m))


SCALES = "sc AS (SELECT " + ", ".join(f"stddev_samp({f}) AS s_{f}" for f in FEATURES) + " FROM lineitem)"


# Two trees over line items: tree, node, feature, threshold, left, right, value. Their covers are counted on the table.
TREES = [
    (0, 0, "l_quantity", 25.0, 1, 2, None), (0, 1, "l_discount", 0.04, 3, 4, None), (0, 2, "l_extendedprice", 50000.0, 5, 6, None),
    (0, 3, None, None, None, None, 0.2), (0, 4, None, None, None, None, -0.1), (0, 5, None, None, None, None, 0.05),
    (0, 6, "l_quantity", 40.0, 7, 8, None), (0, 7, None, None, None, None, 0.3), (0, 8, None, None, None, None, -0.25),
    (1, 0, "l_tax", 0.03, 1, 2, None), (1, 1, None, None, None, None, -0.15), (1, 2, "l_quantity", 10.0, 3, 4, None),
    (1, 3, None, None, None, None, 0.4), (1, 4, None, None, None, None, 0.0625),
]


def trees(s, d):
    nodes = s.createDataFrame(TREES, "tree int, node int, feature string, threshold double, left int, right int, value double")
    nodes = nodes.withColumn("missing_left", F.lit(True))
    return R.tree_ensemble(R.with_covers(nodes, lines(s, d), FEATURES), offset=0.1)


def tree_sql() -> str:
    """covers(c_tree_node), leaves by cases, and ``tatt``: feature, v for every row by the formula over subsets of a path."""
    node = {(t, n): x for t, n, *x in TREES}
    paths = {}

    def down(t, n, conditions, steps):
        paths[t, n] = (conditions, steps)
        feature, threshold, left, right, _ = node[t, n]
        if feature:
            for child, sign in ((left, "<="), (right, ">")):
                down(t, child, [*conditions, f"{feature} {sign} {threshold}"], [*steps, (feature, f"{feature} {sign} {threshold}", (t, n), (t, child))])

    for t in {t for t, _ in node}:
        down(t, 0, [], [])
    name = lambda k: f"c_{k[0]}_{k[1]}"
    covers = ", ".join(f"greatest(count(*) FILTER ({' AND '.join(c) or 'true'}), 1)::DOUBLE AS {name(k)}" for k, (c, _) in paths.items())
    gains = {f: [] for f in FEATURES}
    base, score = [], []
    for k, (conditions, steps) in paths.items():
        if node[k][0]:
            continue
        value, parts = node[k][4], {}
        for f, cond, above, below in steps:
            o, z = parts.get(f, ([], []))
            parts[f] = ([*o, cond], [*z, f"{name(below)} / {name(above)}"])
        o = {f: f"({' AND '.join(c)})::INT" for f, (c, _) in parts.items()}
        zs = {f: "(" + " * ".join(z) + ")" for f, (_, z) in parts.items()}
        base.append(" * ".join([str(value), *zs.values()]))
        score.append(" * ".join([str(value), *o.values()]))
        for f in parts:
            others = [g for g in parts if g != f]
            if not others:
                rest = "1"
            elif len(others) == 1:
                rest = f"({zs[others[0]]} + {o[others[0]]}) / 2.0"
            else:
                a, b = others
                rest = f"({zs[a]} * {zs[b]} / 3.0 + ({o[a]} * {zs[b]} + {zs[a]} * {o[b]}) / 6.0 + {o[a]} * {o[b]} / 3.0)"
            gains[f].append(f"{value} * ({o[f]} - {zs[f]}) * {rest}")
    cells = " UNION ALL ".join(f"SELECT '{f}' AS feature, {' + '.join(g) or '0.0'} AS v FROM lineitem, covers" for f, g in gains.items())
    return f"covers AS (SELECT {covers} FROM lineitem), tatt AS ({cells}), tscore AS (SELECT 0.1 + {' + '.join(score)} AS p, 0.1 + {' + '.join(base)} AS base FROM lineitem, covers)"


def register(r: Registry) -> None:
    probs = f"pr AS (SELECT *, {z()} AS p FROM lineitem)"
    agg = f"count(*) AS n, {r6('avg(p)', 'mean_p')}, {r6('min(p)', 'min_p')}, {r6('max(p)', 'max_p')}, sum((p >= 0.5)::INT)::BIGINT AS positives"

    def summary(df):
        p = F.col("p")
        return rounded(df.agg(F.count("p").alias("n"), F.avg(p).alias("mean_p"), F.min(p).alias("min_p"), F.max(p).alias("max_p"),
                              F.count_if(p >= 0.5).alias("positives")))

    r.add("md1_score_linear", lambda s, d: summary(S.score(lines(s, d), MODEL, FEATURES)), f"WITH {probs} SELECT {agg} FROM pr")
    r.add("md1_score_python", lambda s, d: summary(S.score(lines(s, d), by_hand, FEATURES)), f"WITH {probs} SELECT {agg} FROM pr")
    r.add(
        "rb1_feature_scales",
        lambda s, d: rounded(B.feature_scales(lines(s, d), FEATURES)),
        " UNION ALL ".join(f"SELECT '{f}' AS feature, {r6(f'stddev_samp({f})', 'scale')} FROM lineitem" for f in FEATURES),
    )
    r.add("rb2_jitter_sensitivity", lambda s, d: rounded(B.jitter_sensitivity(lines(s, d), MODEL, FEATURES, KEY, "y")))
    r.add("rb3_feature_sensitivity", lambda s, d: rounded(B.feature_sensitivity(lines(s, d), MODEL, FEATURES, KEY)))
    moves = " UNION ALL ".join(
        f"SELECT {i} AS o, '{f}' AS feature, {dbl(v)} AS factor, *, ({z()} >= 0.5) <> ({z({f: f'{f} {g} {dbl(v)} * s_{f}'})} >= 0.5) AS flip FROM lineitem, sc"
        for i, f in enumerate(FEATURES) for v in B.FACTORS for g in ("+", "-")
    )
    best = f"""{SCALES}, mv AS ({moves}), bd AS (SELECT {', '.join(KEY)}, min(struct_pack(f := factor, o := o, n := feature)) FILTER (flip) AS b FROM mv
        GROUP BY {', '.join(KEY)}), dist AS (SELECT b.n AS feature, b.f AS distance FROM bd)"""
    r.add(
        "rb4_boundary_search",
        lambda s, d: rounded(B.boundary_summary(B.boundary_distances(lines(s, d), MODEL, FEATURES, KEY))),
        f"""WITH {best} SELECT {r6('quantile_cont(distance, 0.5)', 'median_distance')}, count(*) AS n, count(distance) AS flipped, {r6('min(distance)', 'min_distance')},
        {r6('max(distance)', 'max_distance')}, {r6('count(distance)::DOUBLE / count(*)', 'flip_rate')} FROM dist""",
    )
    r.add(
        "rb4_boundary_features",
        lambda s, d: rounded(B.boundary_features(B.boundary_distances(lines(s, d), MODEL, FEATURES, KEY))),
        f"WITH {best} SELECT feature, count(*) AS flips, {r6('quantile_cont(distance, 0.5)', 'median_distance')} FROM dist WHERE feature IS NOT NULL GROUP BY 1",
    )
    r.add(
        "rb4_boundary_python",
        lambda s, d: rounded(B.boundary_features(B.boundary_distances(lines(s, d), by_hand, FEATURES, KEY))),
        f"WITH {best} SELECT feature, count(*) AS flips, {r6('quantile_cont(distance, 0.5)', 'median_distance')} FROM dist WHERE feature IS NOT NULL GROUP BY 1",
    )
    r.add("rb5_missingness_stress", lambda s, d: rounded(B.missingness_stress(lines(s, d), MODEL, FEATURES, KEY, "y")))
    r.add("rb6_subgroup_robustness", lambda s, d: rounded(B.subgroup_robustness(lines(s, d), MODEL, FEATURES, KEY, "l_linestatus")))

    def report(s, d):
        l = lines(s, d)
        return B.robustness_report(B.robustness_findings(
            B.jitter_sensitivity(l, MODEL, FEATURES, KEY), B.boundary_distances(l, MODEL, FEATURES, KEY),
            B.subgroup_robustness(l, MODEL, FEATURES, KEY, "l_linestatus")))

    r.add("rb7_robustness_report", report)
    r.add("xp1_permutation_importance", lambda s, d: rounded(X.permutation_importance(lines(s, d), MODEL, "y", FEATURES, KEY, 3)))

    def shuffled_sums(s, d):
        out = X.shuffled(lines(s, d), FEATURES, KEY, 2)
        aggs = [F.sum(F.col(f"_d{i}").getField(f)).alias(f"s{i}_{f}") for i in range(2) for f in ("l_quantity", "l_extendedprice")]
        return rounded(out.agg(*aggs), 2)

    r.add(
        "xp1_shuffle_keeps_values",
        shuffled_sums,
        "SELECT " + ", ".join(f"round(sum({f}) + 2e-9, 2) + 0.0 AS s{i}_{f}" for i in range(2) for f in ("l_quantity", "l_extendedprice")) + " FROM lineitem",
    )
    means = "mm AS (SELECT " + ", ".join(f"avg({f}) AS m_{f}" for f in FEATURES) + " FROM lineitem)"
    att = " UNION ALL ".join(f"SELECT {', '.join(KEY)}, '{f}' AS feature, {f}::DOUBLE AS x, ({f} - m_{f}) * {dbl(COEF[f])} AS v FROM lineitem, mm" for f in FEATURES)
    glob = f"""{means}, att AS ({att}), ga AS (SELECT feature, count(*) AS n, avg(abs(v)) AS ma, avg(v) AS ms, quantile_cont(abs(v), 0.5) AS md,
        avg((v > 0)::INT) AS pr, avg((v < 0)::INT) AS nr FROM att GROUP BY 1), gr AS (SELECT *, ma / sum(ma) OVER () AS share, row_number() OVER (ORDER BY ma DESC, feature) AS rank FROM ga)"""
    attr = lambda s, d: S.attribute(lines(s, d), MODEL, FEATURES, KEY)
    r.add(
        "md2_attribute_linear",
        lambda s, d: rounded(attr(s, d).groupBy("feature").agg(F.count("value").alias("n"), F.max("value").alias("hi"), F.min("value").alias("lo"))),
        f"WITH {means}, att AS ({att}) SELECT feature, count(*) AS n, {r6('max(v)', 'hi')}, {r6('min(v)', 'lo')} FROM att GROUP BY 1",
    )
    r.add(
        "xp2_global_attribution",
        lambda s, d: rounded(X.global_attribution(attr(s, d))),
        f"""WITH {glob} SELECT feature, n, {r6('ma', 'mean_abs')}, {r6('ms', 'mean_signed')}, {r6('md', 'median_abs')}, {r6('pr', 'positive_rate')},
        {r6('nr', 'negative_rate')}, {r6('share', 'share')}, rank FROM gr""",
    )
    r.add(
        "md1_score_trees",
        lambda s, d: rounded(S.score(lines(s, d), trees(s, d), FEATURES).agg(F.count("p").alias("n"), F.avg("p").alias("mean_p"), F.min("p").alias("min_p"), F.max("p").alias("max_p"))),
        f"WITH {tree_sql()} SELECT count(*) AS n, {r6('avg(p)', 'mean_p')}, {r6('min(p)', 'min_p')}, {r6('max(p)', 'max_p')} FROM tscore",
    )
    tree_rows = lambda s, d: S.attribute(lines(s, d), trees(s, d), FEATURES, KEY)
    r.add(
        "md2_attribute_trees",
        lambda s, d: rounded(tree_rows(s, d).groupBy("feature").agg(
            F.count("value").alias("n"), F.max("value").alias("hi"), F.min("value").alias("lo"), F.avg("value").alias("mean"), F.avg(F.col("value") * F.col("value")).alias("square"))),
        f"WITH {tree_sql()} SELECT feature, count(*) AS n, {r6('max(v)', 'hi')}, {r6('min(v)', 'lo')}, {r6('avg(v)', 'mean')}, {r6('avg(v * v)', 'square')} FROM tatt GROUP BY 1",
    )

    def sums(s, d):
        model = trees(s, d)
        whole = S.attribute(lines(s, d), model, FEATURES, KEY).agg(F.sum("value").alias("v"))
        scored = S.score(lines(s, d), model, FEATURES).agg(F.sum("p").alias("p"), F.count("*").alias("n"))
        return rounded(whole.crossJoin(scored).select("n", F.lit(model.base()).alias("base"), F.abs(F.col("v") + F.col("n") * model.base() - F.col("p")).alias("left_over")))

    r.add(
        "md2_tree_sums",
        sums,
        f"WITH {tree_sql()} SELECT count(*) AS n, {r6('max(base)', 'base')}, 0.0::DOUBLE AS left_over FROM tscore",
    )
    r.add(
        "xp2_global_attribution_trees",
        lambda s, d: rounded(X.global_attribution(tree_rows(s, d))).select("feature", "n", "mean_abs", "mean_signed", "share", "rank"),
        f"""WITH {tree_sql()}, ga AS (SELECT feature, count(*) AS n, avg(abs(v)) AS ma, avg(v) AS ms FROM tatt GROUP BY 1)
        SELECT feature, n, {r6('ma', 'mean_abs')}, {r6('ms', 'mean_signed')}, {r6('ma / sum(ma) OVER ()', 'share')}, row_number() OVER (ORDER BY ma DESC, feature) AS rank FROM ga""",
    )
    r.add(
        "xp3_rank_agreement",
        lambda s, d: rounded(X.rank_agreement(X.global_attribution(attr(s, d)), _by_scale(s, d))),
        f"""WITH {glob}, {SCALES}, b AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, s_{f} AS v FROM sc" for f in FEATURES)}),
        br AS (SELECT feature, row_number() OVER (ORDER BY v DESC) AS rb FROM b) SELECT count(*) AS n_features, {r6('corr(rank, rb)', 'spearman')} FROM gr JOIN br USING (feature)""",
    )
    r.add(
        "xp4_concentration",
        lambda s, d: rounded(X.concentration(X.global_attribution(attr(s, d)))),
        f"""WITH {glob} SELECT {', '.join(r6(f'sum(share) FILTER (rank <= {k})', f'top{k}_share') for k in (1, 3, 5, 10))},
        {r6('-sum(share * ln(share)) / ln(count(*))', 'entropy')} FROM gr""",
    )

    def examples(s, d):
        o = table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
        m = S.LinearModel({"o_totalprice": 0.00001, "o_custkey": -0.001}, -1.7, means={"o_totalprice": 250000.0, "o_custkey": 700.0})
        return rounded(X.local_examples(S.score(o, m, ["o_totalprice", "o_custkey"]), S.attribute(o, m, ["o_totalprice", "o_custkey"], ["o_orderkey"]), "y", "p", ["o_orderkey"]))

    pick = lambda i, name, order, where="true": f"(SELECT {i} AS o, '{name}' AS role, o_orderkey FROM pr WHERE {where} ORDER BY {order}, o_orderkey LIMIT 1)"
    r.add(
        "xp5_local_examples",
        examples,
        f"""WITH pr AS (SELECT o_orderkey, (o_orderstatus = 'F')::INT AS y, o_totalprice, o_custkey, 1 / (1 + exp(-({dbl(-1.7)} + o_totalprice * {dbl(0.00001)} + o_custkey * {dbl(-0.001)}))) AS p FROM orders),
        pk AS ({pick(0, 'MAX_PROBABILITY', 'p DESC')} UNION ALL {pick(1, 'MIN_PROBABILITY', 'p')} UNION ALL {pick(2, 'TRUE_POSITIVE', 'p DESC', 'y = 1 AND p >= 0.5')}
        UNION ALL {pick(3, 'TRUE_NEGATIVE', 'p', 'y = 0 AND p < 0.5')} UNION ALL {pick(4, 'BORDERLINE', 'abs(p - 0.5)')}),
        fr AS (SELECT o_orderkey, arg_min(role, o) AS role FROM pk GROUP BY 1),
        al AS (SELECT role, o_orderkey, y, p, 'o_totalprice' AS feature, o_totalprice AS x, (o_totalprice - 250000.0::DOUBLE) * {dbl(0.00001)} AS v FROM fr JOIN pr USING (o_orderkey)
        UNION ALL SELECT role, o_orderkey, y, p, 'o_custkey', o_custkey, (o_custkey - 700.0::DOUBLE) * {dbl(-0.001)} FROM fr JOIN pr USING (o_orderkey))
        SELECT role, o_orderkey, {r6('p', 'p')}, y::BIGINT AS y, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(v) DESC, feature) AS place, feature, {r6('x', 'x')}, {r6('v', 'value')},
        CASE WHEN v >= 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS direction FROM al""",
    )
    found = """f AS (SELECT CASE WHEN t1 >= 0.5 THEN 'dominant_critical' WHEN t1 >= 0.35 THEN 'dominant_elevated' END AS code,
        CASE WHEN t1 >= 0.5 THEN 'HIGH' ELSE 'WARNING' END AS severity FROM cc WHERE t1 >= 0.35 UNION ALL SELECT CASE WHEN t3 >= 0.8 THEN 'concentrated_critical' ELSE 'concentrated_elevated' END,
        CASE WHEN t3 >= 0.8 THEN 'HIGH' ELSE 'WARNING' END FROM cc WHERE t3 >= 0.65)"""
    conc = f"{glob}, cc AS (SELECT sum(share) FILTER (rank <= 1) AS t1, sum(share) FILTER (rank <= 3) AS t3 FROM gr), {found}"
    r.add(
        "xp6_explain_findings",
        lambda s, d: X.explain_findings(X.global_attribution(attr(s, d))).select("code", "severity"),
        f"WITH {conc} SELECT code, severity FROM f",
    )
    r.add(
        "xp6_explain_report",
        lambda s, d: rounded(X.explain_report(X.explain_findings(X.global_attribution(attr(s, d))))),
        f"""WITH {conc}, h AS (SELECT count(*) AS n, greatest(0, 100 - coalesce(sum(CASE severity WHEN 'HIGH' THEN 15 ELSE 5 END), 0))::DOUBLE AS s FROM f)
        SELECT n AS n_findings, 0::BIGINT AS n_critical, s AS health_score, s >= 70 AS passed FROM h""",
    )


def _by_scale(s, d):
    from pyspark.sql import Window

    sc = B.feature_scales(lines(s, d), FEATURES)
    return sc.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("scale"))))
