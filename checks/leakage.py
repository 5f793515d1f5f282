"""Leakage and contamination queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import association as A
from plumbline.operators import leakage as L
from plumbline.operators import neighbours as N

from .common import PAIR, SCORED_DOCS, Registry, line_pair, r6, rounded, scored_docs, table

CELLS = """cells AS (SELECT feature, a, b, count(*)::DOUBLE AS n FROM tall WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2, 3),
marg AS (SELECT *, sum(n) OVER (PARTITION BY feature, a) AS na, sum(n) OVER (PARTITION BY feature, b) AS nb,
  sum(n) OVER (PARTITION BY feature) AS m FROM cells),
full_cells AS (SELECT r.feature, r.na, c.nb, r.m, coalesce(x.n, 0) AS n FROM (SELECT DISTINCT feature, a, na, m FROM marg) r
  JOIN (SELECT DISTINCT feature, b, nb FROM marg) c USING (feature) LEFT JOIN cells x ON x.feature = r.feature AND x.a = r.a AND x.b = c.b),
levels AS (SELECT feature, count(DISTINCT a) AS la, count(DISTINCT b) AS lb, max(m) AS m,
  sum(n / m * ln(n * m / (na * nb))) AS mi FROM marg GROUP BY 1),
chi AS (SELECT feature, sum((n - na * nb / m) * (n - na * nb / m) / (na * nb / m)) AS chi2 FROM full_cells GROUP BY 1),
assoc AS (SELECT l.feature, l.m::BIGINT AS n, greatest(l.mi, 0) AS mi,
  CASE WHEN least(la, lb) < 2 THEN 0 ELSE least(sqrt(chi2 / (m * (least(la, lb) - 1))), 1) END AS v FROM levels l JOIN chi USING (feature))"""

DOC_TALL = f"{SCORED_DOCS}, tall AS (SELECT 'lang' AS feature, lang AS a, y::VARCHAR AS b FROM scored UNION ALL SELECT 'source', source, y::VARCHAR FROM scored UNION ALL SELECT 'toxic', toxic::VARCHAR, y::VARCHAR FROM scored)"
LINE_TALL = """tall AS (SELECT 'l_linestatus' AS feature, l_linestatus AS a, l_returnflag AS b FROM lineitem
  UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, l_returnflag FROM lineitem)"""


def _psi(n: str) -> str:
    y = f"({n} + 6.0)"
    q = f"(1.0 / ({y} * {y}))"
    steps = " - ".join(f"1.0 / ({n} + {i}.0)" for i in range(6))
    return f"(ln({y}) - 0.5 / {y} + {q} * (-1.0 / 12 + {q} * (1.0 / 120 + {q} * (-1.0 / 252 + {q} / 240))) - {steps})"


def _moved(value: str) -> str:
    """A value moved by its draw, as the operator does; ``g`` is the range of the feature."""
    text = f"concat_ws('|', '42', '{value}', feature, key)"
    return f"{value} + g_{value} * 1e-10::DOUBLE * (('0x' || substr(md5({text}), 1, 13))::BIGINT::DOUBLE / {16**13 // 2}.0::DOUBLE - 1.0)"


def _counted(points: str, value: str, out: str) -> str:
    """Values nearer than r: a running count over values and the ends of all intervals."""
    reach = f"(r - least((abs({value}) + r) * 1e-15::DOUBLE, r / 4))"
    return f"""ev_{out} AS (SELECT feature, key, {value} AS spot, 1 AS kind, 0 AS sign, 1 AS w FROM {points}
  UNION ALL SELECT feature, key, {value} + {reach}, CASE WHEN r = 0 THEN 3 ELSE 0 END, 1, 0 FROM {points}
  UNION ALL SELECT feature, key, {value} - {reach}, CASE WHEN r = 0 THEN 0 ELSE 2 END, -1, 0 FROM {points}),
run_{out} AS (SELECT *, sum(w) OVER (PARTITION BY feature ORDER BY spot, kind, key, sign ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS below FROM ev_{out}),
{out} AS (SELECT feature, key, sum(sign * below)::DOUBLE AS m FROM run_{out} WHERE sign <> 0 GROUP BY 1, 2)"""


def _between(a: int, m: int) -> str:
    left, right = f"(v - lag(v, {a}) OVER w)", f"(lead(v, {m - a}) OVER w - v)"
    return left if a == m else right if a == 0 else f"CASE WHEN {left} IS NOT NULL AND {right} IS NOT NULL THEN greatest({left}, {right}) END"


def class_neighbours_sql(base: str) -> str:
    """``base`` has feature, key, cls, v; gives class_mi(feature, n, mi)."""
    radius = " ".join(f"WHEN k = {m} THEN least({', '.join(_between(a, m) for a in range(m + 1))})" for m in (1, 2, 3))
    return f"""spans AS (SELECT feature, max(v) - min(v) AS g_v FROM {base} GROUP BY 1),
moved AS (SELECT feature, key, cls, {_moved('v')} AS v FROM {base} JOIN spans USING (feature)),
sized AS (SELECT *, count(*) OVER (PARTITION BY feature, cls) AS n_cls FROM moved),
kept AS (SELECT *, least(3, n_cls - 1) AS k FROM sized WHERE n_cls > 1),
pts AS (SELECT *, CASE {radius} END AS r FROM kept WINDOW w AS (PARTITION BY feature, cls ORDER BY v, key)),
{_counted('pts', 'v', 'around')},
class_mi AS (SELECT p.feature, count(*) AS n, greatest({_psi('count(*)')} + avg({_psi('k')}) - avg({_psi('n_cls')}) - avg({_psi('m')}), 0) AS mi
  FROM pts p JOIN around USING (feature, key) GROUP BY 1)"""


def plane_neighbours_sql(base: str) -> str:
    """``base`` has feature, key, x, y; gives plane_mi(feature, n, mi)."""
    sd = lambda v: f"round(stddev_pop({v}) / pow(10, floor(log10(stddev_pop({v})))), 5) * pow(10, floor(log10(stddev_pop({v}))))"
    return f"""sds AS (SELECT feature, {sd('x')} AS sx, {sd('y')} AS sy FROM {base} GROUP BY 1),
scaled AS (SELECT feature, key, x / sx AS x, y / sy AS y FROM {base} JOIN sds USING (feature)),
spans AS (SELECT feature, max(x) - min(x) AS g_x, max(y) - min(y) AS g_y FROM scaled GROUP BY 1),
moved AS (SELECT feature, key, {_moved('x')} AS x, {_moved('y')} AS y FROM scaled JOIN spans USING (feature)),
apart AS (SELECT a.feature, a.key, greatest(abs(a.x - b.x), abs(a.y - b.y)) AS d FROM moved a JOIN moved b ON a.feature = b.feature AND a.key <> b.key),
nearest AS (SELECT feature, key, list_sort(min(d, 3))[3] AS r FROM apart GROUP BY 1, 2),
pts AS (SELECT moved.*, r FROM moved JOIN nearest USING (feature, key)),
{_counted('pts', 'x', 'by_x')}, {_counted('pts', 'y', 'by_y')},
plane_mi AS (SELECT p.feature, count(*) AS n, greatest({_psi('count(*)')} + {_psi('3')} - avg({_psi('by_x.m')}) - avg({_psi('by_y.m')}), 0) AS mi
  FROM pts p JOIN by_x USING (feature, key) JOIN by_y USING (feature, key) GROUP BY 1)"""


SPENDING = """spending AS (SELECT o_custkey, avg(o_totalprice::DOUBLE) AS mean_price, max(o_totalprice)::DOUBLE AS top_price, count(*) AS n_orders,
  min(o_totalprice)::DOUBLE AS low_price, first(o_orderpriority ORDER BY o_orderkey) AS first_priority FROM orders GROUP BY 1)"""


def spending(s, d):
    """Order prices by customer."""
    price = F.col("o_totalprice").cast("double")
    return table(s, d, "orders").groupBy("o_custkey").agg(
        F.avg(price).alias("mean_price"), F.max(price).alias("top_price"), F.count("*").alias("n_orders"), F.min(price).alias("low_price"),
        F.min_by("o_orderpriority", "o_orderkey").alias("first_priority"),
    )


def _docs(s, d):
    return scored_docs(s, d).select("lang", "source", "n_chars", "toxic", "p", "y")


def register(r: Registry) -> None:
    r.add(
        "lk1_target_profile",
        lambda s, d: L.target_profile(table(s, d, "lineitem"), "l_returnflag"),
        """SELECT count(*) AS n_rows, count(DISTINCT l_returnflag) AS n_classes, 'MULTICLASS_CLASSIFICATION' AS task FROM lineitem""",
    )
    r.add(
        "lk1_target_regression",
        lambda s, d: L.target_profile(table(s, d, "orders"), "o_totalprice"),
        "SELECT count(*) AS n_rows, count(DISTINCT o_totalprice) AS n_classes, 'REGRESSION' AS task FROM orders",
    )
    r.add(
        "lk1_class_balance",
        lambda s, d: rounded(L.class_balance(table(s, d, "lineitem"), "l_returnflag")),
        f"SELECT l_returnflag AS class, count(*) AS n, {r6('count(*)::DOUBLE / sum(count(*)) OVER ()', 'share')} FROM lineitem GROUP BY 1",
    )
    r.add(
        "lk2_pearson",
        lambda s, d: rounded(A.pearson(table(s, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("double")),
                                       ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], F.col("y"))),
        " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS n, {r6(f'''corr({c}, (l_returnflag = 'R')::INT)''', 'r')} FROM lineitem"
                           for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
    )
    eta = lambda c: f"""SELECT '{c}' AS feature, sum(n)::BIGINT AS n, {r6('sqrt(sum(n * (mu - g) * (mu - g)) / (sum(n * (mu - g) * (mu - g)) + sum(n * v)))', 'eta')}
        FROM (SELECT l_returnflag, count(*) AS n, avg({c}) AS mu, var_pop({c}) AS v FROM lineitem GROUP BY 1) a, (SELECT avg({c}) AS g FROM lineitem) b"""  # noqa: E731
    r.add(
        "lk3_correlation_ratio",
        lambda s, d: rounded(A.correlation_ratio(
            table(s, d, "lineitem"), {c: F.col("l_returnflag") for c in ("l_quantity", "l_extendedprice")},
            {c: F.col(c) for c in ("l_quantity", "l_extendedprice")})),
        f"{eta('l_quantity')} UNION ALL {eta('l_extendedprice')}",
    )
    r.add(
        "lk4_cramers_v",
        lambda s, d: rounded(A.cramers_v(table(s, d, "lineitem"), ["l_linestatus", "l_linenumber"], "l_returnflag")),
        f"WITH {LINE_TALL}, {CELLS} SELECT feature, n, {r6('v', 'cramers_v')} FROM assoc",
    )
    doc_assoc = f"""assoc2 AS (SELECT feature, 'CRAMERS_V' AS measure, v AS a, n FROM assoc WHERE feature IN ('lang', 'source')
        UNION ALL SELECT 'n_chars', 'PEARSON', corr(n_chars, y), count(*) FROM scored UNION ALL SELECT 'toxic', 'PEARSON', corr(toxic, y), count(*) FROM scored
        UNION ALL SELECT 'p', 'PEARSON', corr(p, y), count(*) FROM scored)"""
    r.add(
        "lk5_target_association",
        lambda s, d: rounded(L.target_association(_docs(s, d), "y")),
        f"WITH {DOC_TALL}, {CELLS}, {doc_assoc} SELECT feature, measure, {r6('a', 'association')}, n FROM assoc2",
    )
    r.add(
        "lk6_mutual_information_discrete",
        lambda s, d: rounded(A.mutual_information(scored_docs(s, d), ["lang", "source", "toxic"], F.col("y"))),
        f"WITH {DOC_TALL}, {CELLS} SELECT feature, n, {r6('mi', 'mi')} FROM assoc",
    )

    def edges(c: str, src: str, bins: int) -> str:
        qs = ", ".join(f"{i}.0::DOUBLE / {bins}" for i in range(1, bins))
        return f"(SELECT list_distinct(quantile_cont({c}::DOUBLE, [{qs}])) AS e FROM {src})"

    def code(c: str, src: str, alias: str, bins: int = 20) -> str:
        return f"SELECT '{c}' AS feature, len(list_filter(e, lambda x: x <= {c}))::VARCHAR AS a, {alias} AS b FROM {src}, {edges(c, src, bins)} q"

    r.add(
        "lk6_mutual_information_binned",
        lambda s, d: rounded(A.mutual_information(table(s, d, "lineitem"), ["l_extendedprice", "l_quantity"], F.col("l_returnflag"))),
        f"WITH tall AS ({code('l_extendedprice', 'lineitem', 'l_returnflag')} UNION ALL {code('l_quantity', 'lineitem', 'l_returnflag')}), {CELLS} SELECT feature, n, {r6('mi', 'mi')} FROM assoc",
    )
    tall = " UNION ALL ".join(f"SELECT '{c}' AS feature, concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS key, l_returnflag AS cls, {c}::DOUBLE AS v FROM lineitem"
                              for c in ("l_extendedprice", "l_quantity", "l_discount"))
    r.add(
        "lk6_mutual_information_neighbours",
        lambda s, d: rounded(N.neighbour_information(
            table(s, d, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("double")),
            ["l_extendedprice", "l_quantity", "l_discount", "l_linestatus"], "l_returnflag", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])),
        f"""WITH base AS ({tall}), {class_neighbours_sql('base')}, tall AS (SELECT 'l_linestatus' AS feature, l_linestatus AS a, l_returnflag AS b FROM lineitem), {CELLS}
        SELECT feature, n, {r6('mi', 'mi')}, 'class_neighbours' AS estimator FROM class_mi UNION ALL SELECT feature, n, {r6('mi', 'mi')}, 'plug_in' FROM assoc""",
    )
    pairs = " UNION ALL ".join(f"SELECT '{c}' AS feature, o_custkey::VARCHAR AS key, {c} AS x, mean_price AS y FROM spending" for c in ("top_price", "low_price"))
    r.add(
        "lk6_mutual_information_plane",
        lambda s, d: rounded(N.neighbour_information(spending(s, d), ["top_price", "low_price"], "mean_price", ["o_custkey"], regression=True), 4),
        f"""WITH {SPENDING}, base AS ({pairs}), {plane_neighbours_sql('base')}
        SELECT feature, n, {r6('mi', 'mi', 4)}, 'plane_neighbours' AS estimator FROM plane_mi""",
    )
    levels = " UNION ALL ".join(f"SELECT '{c}' AS feature, o_custkey::VARCHAR AS key, {c}::VARCHAR AS cls, mean_price AS v FROM spending" for c in ("n_orders", "first_priority"))
    r.add(
        "lk6_mutual_information_levels",
        lambda s, d: rounded(N.neighbour_information(spending(s, d), ["n_orders", "first_priority"], "mean_price", ["o_custkey"], regression=True)),
        f"""WITH {SPENDING}, base AS ({levels}), {class_neighbours_sql('base')}
        SELECT feature, n, {r6('mi', 'mi')}, 'class_neighbours' AS estimator FROM class_mi""",
    )
    rank = f"""{DOC_TALL.replace('tall AS (', 'tall AS (' + code('n_chars', 'scored', 'y::VARCHAR') + ' UNION ALL ' + code('p', 'scored', 'y::VARCHAR') + ' UNION ALL ')}, {CELLS}, {doc_assoc},
        rk AS (SELECT feature, mi, measure, a, assoc2.n, mi * 0.6 + abs(a) * 0.4 AS s,
        CASE WHEN mi >= 0.7 OR abs(a) >= 0.85 THEN 'CRITICAL' WHEN mi >= 0.5 OR abs(a) >= 0.65 THEN 'HIGH' WHEN mi >= 0.3 OR abs(a) >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk
        FROM assoc JOIN assoc2 USING (feature))"""
    r.add(
        "lk7_leakage_rank",
        lambda s, d: rounded(L.leakage_rank(_docs(s, d), "y")),
        f"""WITH {rank} SELECT feature, {r6('mi', 'mi')}, measure, {r6('a', 'association')}, n, risk, mi >= 0.75 OR abs(a) >= 0.85 AS is_proxy,
        {r6('s', 'suspicion')} FROM rk""",
    )
    overlap_sql = """e AS (SELECT DISTINCT text, lang FROM documents WHERE doc_id % 2 = 1), b AS (SELECT DISTINCT text, lang FROM documents WHERE doc_id % 2 = 0),
        o AS (SELECT count(*) AS k FROM e WHERE EXISTS (SELECT 1 FROM b WHERE b.text = e.text AND b.lang = e.lang)), t AS (SELECT count(*) AS n FROM e)"""

    def halves(s, d):
        docs = table(s, d, "documents").select("doc_id", "text", "lang")
        odd = F.col("doc_id") % 2 == 1
        return docs.filter(odd).drop("doc_id"), docs.filter(~odd).drop("doc_id")

    r.add(
        "lk8_sample_overlap",
        lambda s, d: rounded(L.sample_overlap(*halves(s, d))),
        f"""WITH {overlap_sql} SELECT n AS distinct_eval, k AS overlap_count, {r6('k::DOUBLE / n', 'overlap_rate')},
        CASE WHEN k::DOUBLE / n >= 0.02 THEN 'CRITICAL' WHEN k::DOUBLE / n >= 0.001 THEN 'WARNING' END AS severity FROM o, t""",
    )
    r.add(
        "lk8_sample_overlap_lines",
        lambda s, d: rounded(L.sample_overlap(*reversed([x.select("l_partkey", "l_suppkey", "l_quantity") for x in line_pair(s, d)]))),
        f"""WITH {PAIR}, e AS (SELECT DISTINCT l_partkey, l_suppkey, l_quantity FROM evalt), b AS (SELECT DISTINCT l_partkey, l_suppkey, l_quantity FROM base),
        t AS (SELECT count(*) AS n, (SELECT count(*) FROM e JOIN b USING (l_partkey, l_suppkey, l_quantity)) AS k FROM e)
        SELECT n AS distinct_eval, k AS overlap_count, {r6('k::DOUBLE / n', 'overlap_rate')},
        CASE WHEN k::DOUBLE / n >= 0.02 THEN 'CRITICAL' WHEN k::DOUBLE / n >= 0.001 THEN 'WARNING' END AS severity FROM t""",
    )
    r.add(
        "jn1_fingerprint_semi_join",
        lambda s, d: L.overlapping_rows(*halves(s, d)).groupBy("lang").agg(F.count(F.lit(1)).alias("n")),
        """SELECT lang, count(*) AS n FROM documents e WHERE doc_id % 2 = 1 AND EXISTS (SELECT 1 FROM documents b WHERE b.doc_id % 2 = 0
        AND b.text = e.text AND b.lang = e.lang) GROUP BY 1""",
    )
    finding = f"""{rank}, f AS (SELECT feature, 'leak_critical' AS code, 'CRITICAL' AS severity, s AS value FROM rk WHERE risk = 'CRITICAL'
        UNION ALL SELECT feature, 'leak_high', 'HIGH', s FROM rk WHERE risk = 'HIGH')"""
    r.add(
        "lk9_leakage_findings",
        lambda s, d: rounded(L.leakage_findings(_docs(s, d), "y").select("feature", "code", "severity", "value")),
        f"WITH {finding} SELECT feature, code, severity, {r6('value', 'value')} FROM f",
    )
    r.add(
        "lk9_leakage_health",
        lambda s, d: rounded(L.leakage_health(L.leakage_findings(
            _docs(s, d).withColumn("copied", F.col("y").cast("double") + F.col("p") / 10), "y"))),
    )
