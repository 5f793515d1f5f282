"""Profile and quality queries: orders as they are, and orders with planted faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.cumulative import quantiles
from plumbline.operators import predicates as P
from plumbline.operators import quality as Q
from plumbline.operators import sketches as K
from plumbline.session import cut_lineage

from .common import MESSY, MESSY_COLUMNS, MESSY_NUMERIC, Registry, dbl, messy_orders, r6, rounded, table

COUNTS = "counts AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c}::VARCHAR AS value, count(*) AS n FROM messy "
    f"WHERE {c} IS NOT NULL{' AND NOT isnan(o_totalprice)' if c == 'o_totalprice' else ''} GROUP BY 2"
    for c in MESSY_COLUMNS
) + ")"


def _missing(c: str) -> str:
    return f"({c} IS NULL OR isnan({c}))" if c == "o_totalprice" else f"({c} IS NULL)"


MISSING = "miss AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) AS n_rows, sum({_missing(c)}::INT)::BIGINT AS missing_count FROM messy" for c in MESSY_COLUMNS
) + ")"
FINITE = "fin AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c}::DOUBLE AS value FROM messy WHERE {c} IS NOT NULL AND isfinite({c}::DOUBLE)" for c in MESSY_NUMERIC
) + ")"
FENCES = """q AS (SELECT feature, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM fin GROUP BY 1),
fences AS (SELECT feature, n, q3 > q1 AS wide, CASE WHEN q3 > q1 THEN q1 - (q3 - q1) * 1.5 ELSE q1 END AS lo,
  CASE WHEN q3 > q1 THEN q3 + (q3 - q1) * 1.5 ELSE q3 END AS hi FROM q),
outl AS (SELECT f.feature, f.n, f.lo, f.hi, sum((f.wide AND (value < lo OR value > hi))::INT)::BIGINT AS k
  FROM fin JOIN fences f USING (feature) GROUP BY 1, 2, 3, 4)"""
NUMERIC = "nums AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, sum(coalesce(isinf({c}::DOUBLE), false)::INT)::BIGINT AS infinite_count, count(*) AS n_rows FROM messy"""
    for c in MESSY_NUMERIC
) + "), summ AS (SELECT feature, count(*) AS finite_count, min(value) AS mn, max(value) AS mx, avg(value) AS mu, stddev_samp(value) AS sd FROM fin GROUP BY 1)"
DOMINANT = """top AS (SELECT feature, count(*) AS distinct_count, sum(n) AS present,
  arg_min(value, struct_pack(a := -n, b := value)) AS dominant_value, max(n) AS top_n FROM counts GROUP BY 1)"""


def _priced(df):
    """Text of doubles differs between engines, so dominant prices are compared as numbers."""
    is_price = F.col("feature") == "o_totalprice"
    return df.withColumn("dominant_value", F.when(is_price | (F.col("feature") == "o_orderdate"), F.lit(None)).otherwise(F.col("dominant_value")))


DOM = "CASE WHEN feature IN ('o_totalprice', 'o_orderdate') THEN NULL ELSE dominant_value END AS dominant_value"


def register(r: Registry) -> None:
    r.add(
        "dq1_dataset_overview",
        lambda s, d: rounded(Q.dataset_overview(messy_orders(s, d))),
        f"""WITH {MESSY}, {MISSING}, t AS (SELECT max(n_rows) AS n, sum(missing_count)::BIGINT AS m FROM miss)
        SELECT n AS n_rows, 7::BIGINT AS n_columns, n * 7 AS n_cells, m AS missing_cells, {r6('m::DOUBLE / (n * 7)', 'missing_rate')} FROM t""",
    )
    r.add(
        "dq2_duplicate_rows",
        lambda s, d: rounded(Q.duplicate_rows(messy_orders(s, d))),
        f"""WITH {MESSY}, g AS (SELECT count(*) AS n FROM messy GROUP BY {', '.join(MESSY_COLUMNS)})
        SELECT sum(n)::BIGINT AS n_rows, sum(n - 1)::BIGINT AS duplicate_rows, {r6('sum(n - 1)::DOUBLE / sum(n)', 'duplicate_rate')} FROM g""",
    )
    r.add(
        "dq2_duplicate_documents",
        lambda s, d: rounded(Q.duplicate_rows(table(s, d, "documents").select("text", "lang"))),
        f"""WITH g AS (SELECT count(*) AS n FROM documents GROUP BY text, lang)
        SELECT sum(n)::BIGINT AS n_rows, sum(n - 1)::BIGINT AS duplicate_rows, {r6('sum(n - 1)::DOUBLE / sum(n)', 'duplicate_rate')} FROM g""",
    )
    r.add(
        "dq3_missingness",
        lambda s, d: rounded(Q.missingness(messy_orders(s, d))),
        f"""WITH {MESSY}, {MISSING} SELECT feature, n_rows, missing_count, {r6('missing_count::DOUBLE / n_rows', 'missing_rate')} FROM miss""",
    )
    r.add(
        "dq3_missingness_summary",
        lambda s, d: rounded(Q.missingness_summary(messy_orders(s, d))),
        f"""WITH {MESSY}, {MISSING} SELECT sum((missing_count > 0)::INT)::BIGINT AS columns_with_missing,
        {r6('max(missing_count::DOUBLE / n_rows)', 'max_missing_rate')} FROM miss""",
    )
    kind = """CASE WHEN feature IN ('o_orderdate') THEN 'DATETIME'
        WHEN d = 2 AND t = 2 THEN 'BOOLEAN' WHEN feature IN ('o_custkey', 'o_totalprice', 'flag') THEN 'NUMERIC'
        WHEN chars > present * 60 AND d > present * 0.4 THEN 'TEXT' ELSE 'CATEGORICAL' END"""
    r.add(
        "dq4_semantic_types",
        lambda s, d: Q.semantic_types(messy_orders(s, d)),
        f"""WITH {MESSY}, {COUNTS}, g AS (SELECT feature, count(*) AS d, sum((value IN ('0', '1'))::INT) AS t, sum(n) AS present,
        sum(length(value) * n) AS chars FROM counts GROUP BY 1) SELECT feature, {kind} AS semantic_type FROM g""",
    )
    doc_kind = """CASE WHEN feature IN ('doc_id', 'n_chars') THEN 'NUMERIC' WHEN chars > present * 60 AND d > present * 0.4 THEN 'TEXT' ELSE 'CATEGORICAL' END"""
    doc_counts = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::VARCHAR AS value, count(*) AS n FROM documents GROUP BY 2"
                                    for c in ("doc_id", "text", "lang", "source", "n_chars"))
    r.add(
        "dq4_semantic_types_documents",
        lambda s, d: Q.semantic_types(table(s, d, "documents")),
        f"""WITH counts AS ({doc_counts}), g AS (SELECT feature, count(*) AS d, sum(n) AS present, sum(length(value) * n) AS chars
        FROM counts GROUP BY 1) SELECT feature, {doc_kind} AS semantic_type FROM g""",
    )
    r.add(
        "dq5_distinct_counts",
        lambda s, d: Q.distinct_counts(messy_orders(s, d)),
        f"WITH {MESSY}, {COUNTS} SELECT feature, count(*) AS distinct_count FROM counts GROUP BY 1",
    )
    r.add(
        "dq6_dominant_values",
        lambda s, d: rounded(_priced(Q.dominant_values(messy_orders(s, d)))),
        f"""WITH {MESSY}, {COUNTS}, {DOMINANT} SELECT feature, distinct_count, {DOM}, {r6('top_n::DOUBLE / present', 'dominant_rate')},
        distinct_count <= 1 AS is_constant, distinct_count > 1 AND top_n::DOUBLE / present >= 0.98 AS is_near_constant FROM top""",
    )
    numeric_sql = f"""WITH {MESSY}, {FINITE}, {NUMERIC} SELECT feature, infinite_count, {r6('infinite_count::DOUBLE / n_rows', 'infinite_rate')},
        finite_count, {r6('mn', 'min')}, {r6('mx', 'max')}, {r6('mu', 'mean')}, {r6('sd', 'std')} FROM nums JOIN summ USING (feature)"""
    r.add("dq9_numeric_summary", lambda s, d: rounded(Q.numeric_summary(messy_orders(s, d))), numeric_sql)
    r.add(
        "dq7_infinite_values",
        lambda s, d: rounded(Q.numeric_summary(messy_orders(s, d)).select("feature", "infinite_count", "infinite_rate")),
        f"""WITH {MESSY}, {FINITE}, {NUMERIC} SELECT feature, infinite_count, {r6('infinite_count::DOUBLE / n_rows', 'infinite_rate')} FROM nums""",
    )
    r.add(
        "dq8_iqr_outliers",
        lambda s, d: rounded(Q.iqr_outliers(messy_orders(s, d))),
        f"""WITH {MESSY}, {FINITE}, {FENCES} SELECT feature, n AS finite_count, {r6('lo', 'lower_bound')}, {r6('hi', 'upper_bound')},
        k AS outlier_count, {r6('k::DOUBLE / n', 'outlier_rate')} FROM outl""",
    )
    r.add(
        "dq8_iqr_outliers_lines",
        lambda s, d: rounded(Q.iqr_outliers(table(s, d, "lineitem"), ["l_extendedprice", "l_quantity"])),
        f"""WITH fin AS (SELECT 'l_extendedprice' AS feature, l_extendedprice AS value FROM lineitem
        UNION ALL SELECT 'l_quantity', l_quantity FROM lineitem), {FENCES}
        SELECT feature, n AS finite_count, {r6('lo', 'lower_bound')}, {r6('hi', 'upper_bound')}, k AS outlier_count,
        {r6('k::DOUBLE / n', 'outlier_rate')} FROM outl""",
    )
    profile = f"""{MESSY}, {COUNTS}, {MISSING}, {FINITE}, {NUMERIC}, {FENCES}, {DOMINANT}, prof AS (
        SELECT m.feature, m.n_rows, m.missing_count, m.missing_count::DOUBLE / m.n_rows AS missing_rate, t.distinct_count, t.dominant_value,
        t.top_n::DOUBLE / t.present AS dominant_rate, t.distinct_count <= 1 AS is_constant,
        t.distinct_count > 1 AND t.top_n::DOUBLE / t.present >= 0.98 AS is_near_constant, nums.infinite_count, outl.k AS outlier_count,
        outl.k::DOUBLE / outl.n AS outlier_rate, outl.lo, outl.hi, mn, mx, mu, sd
        FROM miss m LEFT JOIN top t USING (feature) LEFT JOIN nums USING (feature) LEFT JOIN summ USING (feature) LEFT JOIN outl USING (feature))"""
    r.add(
        "dq_column_profile",
        lambda s, d: rounded(_priced(Q.column_profile(messy_orders(s, d)).drop("semantic_type"))),
        f"""WITH {profile} SELECT feature, n_rows, missing_count, {r6('missing_rate', 'missing_rate')}, distinct_count, {DOM},
        {r6('dominant_rate', 'dominant_rate')}, is_constant, is_near_constant, infinite_count,
        {r6('infinite_count::DOUBLE / n_rows', 'infinite_rate')}, {r6('mn', 'min')}, {r6('mx', 'max')}, {r6('mu', 'mean')}, {r6('sd', 'std')},
        {r6('lo', 'lower_bound')}, {r6('hi', 'upper_bound')}, outlier_count, {r6('outlier_rate', 'outlier_rate')} FROM prof""",
    )
    finding_sql = f"""{profile}, dup AS (SELECT sum(n - 1)::DOUBLE / sum(n) AS rate FROM
        (SELECT count(*) AS n FROM messy GROUP BY {', '.join(MESSY_COLUMNS)}) z), f AS (
        SELECT feature, 'missing_critical' AS code, 'CRITICAL' AS severity, missing_rate AS value FROM prof WHERE missing_rate >= 0.2
        UNION ALL SELECT feature, 'missing_elevated', 'WARNING', missing_rate FROM prof WHERE missing_rate >= 0.02 AND missing_rate < 0.2
        UNION ALL SELECT feature, 'constant', 'WARNING', distinct_count FROM prof WHERE is_constant
        UNION ALL SELECT feature, 'near_constant', 'INFO', dominant_rate FROM prof WHERE is_near_constant
        UNION ALL SELECT feature, 'infinite_values', 'CRITICAL', infinite_count FROM prof WHERE infinite_count > 0
        UNION ALL SELECT feature, 'outliers_severe', 'HIGH', outlier_rate FROM prof WHERE outlier_rate >= 0.15
        UNION ALL SELECT feature, 'outliers_moderate', 'MEDIUM', outlier_rate FROM prof WHERE outlier_rate >= 0.05 AND outlier_rate < 0.15
        UNION ALL SELECT NULL, 'duplicates_critical', 'CRITICAL', rate FROM dup WHERE rate >= 0.05
        UNION ALL SELECT NULL, 'duplicates_elevated', 'WARNING', rate FROM dup WHERE rate >= 0.01 AND rate < 0.05)"""
    r.add(
        "dq10_quality_findings",
        lambda s, d: rounded(Q.quality_findings(messy_orders(s, d)).select("feature", "code", "severity", "value")),
        f"WITH {finding_sql} SELECT feature, code, severity, {r6('value', 'value')} FROM f",
    )
    r.add(
        "dq10_quality_health",
        lambda s, d: rounded(Q.quality_health(Q.quality_findings(messy_orders(s, d)))),
        f"""WITH {finding_sql}, h AS (SELECT count(*) AS n, sum((severity = 'CRITICAL')::INT)::BIGINT AS c, greatest(0, 100 - sum(
        CASE severity WHEN 'CRITICAL' THEN 25 WHEN 'HIGH' THEN 8 WHEN 'WARNING' THEN 8 WHEN 'MEDIUM' THEN 4 WHEN 'LOW' THEN 1 ELSE 0 END))::DOUBLE AS s FROM f)
        SELECT n AS n_findings, c AS n_critical, s AS health_score, s >= 70 AND c = 0 AS passed FROM h""",
    )
    part_cols = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
    part_counts = " UNION ALL ".join(f"SELECT '{c}' AS feature, trim({c}::VARCHAR) AS value, count(*) AS n FROM part GROUP BY 2" for c in part_cols)
    ranks = ", ".join(
        f"min(CASE WHEN x IS NOT NULL AND c >= ceil({q} * m) THEN x END) AS {n}" for n, q in (("p25", "0.25::DOUBLE"), ("p50", "0.5::DOUBLE"), ("p75", "0.75::DOUBLE"))
    )
    ingest = f"""counts AS ({part_counts}), num AS (SELECT feature, try_cast(value AS DOUBLE) AS x, sum(n) AS n FROM counts
        WHERE try_cast(value AS DOUBLE) IS NOT NULL GROUP BY 1, 2), cum AS (SELECT feature, x, sum(n) OVER (PARTITION BY feature ORDER BY x) AS c,
        sum(n) OVER (PARTITION BY feature) AS m FROM num), rk AS (SELECT feature, {ranks} FROM cum GROUP BY 1),
        g AS (SELECT feature, sum(n)::BIGINT AS n_rows, count(*) AS d, sum(CASE WHEN try_cast(value AS DOUBLE) IS NOT NULL THEN n ELSE 0 END) AS nn,
        sum(CASE WHEN regexp_full_match(value, '-?[0-9]+') THEN n ELSE 0 END) AS ni, max(n) AS top,
        min(try_cast(value AS DOUBLE)) AS mn, max(try_cast(value AS DOUBLE)) AS mx, sum(try_cast(value AS DOUBLE) * n) / sum(n) AS mu FROM counts GROUP BY 1),
        prof AS (SELECT *, CASE WHEN nn = n_rows THEN 'numeric' WHEN d < 30 THEN 'categorical' ELSE 'text' END AS kind FROM g LEFT JOIN rk USING (feature))"""
    r.add(
        "dq11_ingest_profile",
        lambda s, d: rounded(Q.ingest_profile(table(s, d, "part")).drop("examples")),
        f"""WITH {ingest} SELECT feature, kind AS inferred_type, CASE WHEN kind = 'numeric' AND ni = n_rows THEN 'int64' WHEN kind = 'numeric' THEN 'float64'
        ELSE 'object' END AS dtype, n_rows, 0::BIGINT AS null_count, 0.0::DOUBLE AS null_rate, d AS distinct_count,
        {', '.join(r6(f"CASE WHEN kind = 'numeric' THEN {e} END", n) for e, n in (('mn', 'min'), ('mx', 'max'), ('mu', 'mean'), ('p25', 'p25'), ('p50', 'p50'), ('p75', 'p75')))},
        d <= 1 AS is_constant, d > 1 AND n_rows >= 10 AND top::DOUBLE / n_rows >= 0.99 AS is_near_constant,
        regexp_matches(lower(feature), '(^|_)(id|uuid|key|hash)$') OR (d::DOUBLE / n_rows >= 0.95 AND d > 50) AS identifier_like,
        d > 50 OR d::DOUBLE / n_rows > 0.5 AS high_cardinality FROM prof""",
    )
    r.add(
        "dq11_ingest_examples",
        lambda s, d: Q.ingest_profile(table(s, d, "customer")).select(
            "feature", F.concat_ws("|", "examples").alias("examples")).filter(F.col("feature") != "c_acctbal"),
        """WITH c AS (SELECT 'c_custkey' AS feature, c_custkey::VARCHAR AS v FROM customer UNION SELECT 'c_name', c_name FROM customer
        UNION SELECT 'c_nationkey', c_nationkey::VARCHAR FROM customer UNION SELECT 'c_mktsegment', c_mktsegment FROM customer),
        k AS (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) AS rn FROM c)
        SELECT feature, string_agg(v, '|' ORDER BY v) AS examples FROM k WHERE rn <= 5 GROUP BY 1""",
    )

    def labelled(s, d):
        from .common import scored_docs

        return scored_docs(s, d).select("doc_id", "lang", "source", "n_chars", F.col("y").alias("is_label"), "toxic", F.col("p").alias("pred_prob"))

    lab = """lab AS (SELECT d.doc_id::VARCHAR AS doc_id, d.lang, d.source, d.n_chars::VARCHAR AS n_chars, l.quality::VARCHAR AS is_label, l.toxic::VARCHAR AS toxic,
        (d.n_chars / (d.n_chars + 2000.0::DOUBLE)) AS pred_prob FROM documents d JOIN labels l USING (doc_id)),
        card AS (SELECT 'doc_id' AS feature, count(DISTINCT doc_id) AS d, 'numeric' AS kind FROM lab UNION ALL SELECT 'lang', count(DISTINCT lang), 'categorical' FROM lab
        UNION ALL SELECT 'source', count(DISTINCT source), 'categorical' FROM lab UNION ALL SELECT 'n_chars', count(DISTINCT n_chars), 'numeric' FROM lab
        UNION ALL SELECT 'is_label', count(DISTINCT is_label), 'boolean' FROM lab UNION ALL SELECT 'toxic', count(DISTINCT toxic), 'boolean' FROM lab
        UNION ALL SELECT 'pred_prob', count(DISTINCT pred_prob), 'numeric' FROM lab)"""
    r.add(
        "dq12_role_candidates",
        lambda s, d: Q.role_candidates(Q.ingest_profile(labelled(s, d))),
        f"""WITH {lab} SELECT feature, 'target' AS role, d AS distinct_count FROM card WHERE feature IN ('target', 'label', 'y', 'class', 'outcome', 'response', 'fraud', 'default')
        OR starts_with(feature, 'is_') OR d = 2
        UNION ALL SELECT feature, 'prediction', d FROM card WHERE regexp_matches(feature, 'pred|prob|score') OR feature = 'y_hat'
        UNION ALL SELECT feature, 'protected', d FROM card WHERE regexp_matches(feature, 'gender|sex|race|ethnicity|age|foreign|zip|nationality|disability')""",
    )
    r.add(
        "dq13_suggest_targets",
        lambda s, d: rounded(Q.suggest_targets(Q.ingest_profile(labelled(s, d)), ["n_chars", "lang"], "pred_prob")),
        f"""WITH {lab}, sc AS (SELECT feature, CASE WHEN feature IN ('target', 'label', 'y', 'is_fraud', 'fraud', 'default', 'churn', 'outcome', 'response', 'class') THEN 0.45::DOUBLE
        WHEN regexp_matches(feature, '^(is_|has_)') THEN 0.35 ELSE 0 END + CASE WHEN d = 2 THEN 0.35 WHEN d BETWEEN 3 AND 5 AND kind = 'categorical' THEN 0.15 ELSE 0 END
        + CASE WHEN feature NOT IN ('n_chars', 'lang') THEN 0.15 ELSE 0 END + CASE WHEN feature = 'pred_prob' THEN 0.05 ELSE 0 END AS s FROM card)
        SELECT feature, {r6('round(s, 4)', 'score')} FROM sc WHERE round(s, 4) >= 0.30""",
    )
    r.add(
        "dq14_suggest_predictions",
        lambda s, d: rounded(Q.suggest_predictions(Q.ingest_profile(labelled(s, d)))),
        f"""WITH {lab}, sc AS (SELECT feature, CASE WHEN feature = 'pred_prob' THEN 0.9::DOUBLE ELSE 0 END AS s FROM card)
        SELECT feature, {r6('s', 'score')} FROM sc WHERE s >= 0.3""",
    )
    r.add(
        "dq15_validate_inputs",
        lambda s, d: Q.validate_inputs(
            table(s, d, "orders"), table(s, d, "orders").drop("o_custkey").withColumn("o_totalprice", F.col("o_totalprice").cast("string")),
            ["o_totalprice", "o_discount"], "o_orderstatus", "score", "o_custkey"),
        """SELECT * FROM (VALUES ('ERROR', 'PREDICTION_NOT_FOUND', 'score'), ('ERROR', 'MISSING_MODEL_FEATURE', 'o_discount'),
        ('WARNING', 'EXTRA_COLUMN', 'o_orderkey'), ('WARNING', 'EXTRA_COLUMN', 'o_orderdate'), ('WARNING', 'EXTRA_COLUMN', 'o_orderpriority'),
        ('WARNING', 'BASELINE_COLUMN_MISSING', 'o_custkey'), ('ERROR', 'DTYPE_MISMATCH', 'o_totalprice')) v(level, code, subject)
        UNION ALL SELECT 'WARNING', 'TARGET_NOT_BINARY', 'o_orderstatus' FROM orders HAVING count(DISTINCT o_orderstatus) > 2
        UNION ALL SELECT 'WARNING', 'PROTECTED_CARDINALITY', 'o_custkey' FROM orders HAVING count(DISTINCT o_custkey) > 50""",
    )
    r.add(
        "pr1_finite",
        lambda s, d: rounded(messy_orders(s, d).select(F.col("o_totalprice").alias("x")).filter(Q.finite(F.col("x")).isNotNull())
                             .agg(F.count("x").alias("n"), F.avg("x").alias("mean"))),
        f"WITH {MESSY} SELECT count(*) AS n, {r6('avg(o_totalprice)', 'mean')} FROM messy WHERE isfinite(o_totalprice)",
    )
    r.add(
        "pr4_resolve_column",
        lambda s, d: table(s, d, "documents").select(F.lit(P.resolve_column(table(s, d, "documents"), ["score", "n_chars", "lang"])).alias("name"))
        .groupBy("name").count().withColumnRenamed("count", "n"),
        "SELECT 'n_chars' AS name, count(*) AS n FROM documents",
    )
    r.add(
        "pr5_numeric_features",
        lambda s, d: rounded(Q.numeric_summary(table(s, d, "lineitem"), P.numeric_features(table(s, d, "lineitem"), ["l_orderkey", "l_partkey"]))
                             .select("feature", "mean")),
        f"""SELECT 'l_suppkey' AS feature, {r6('avg(l_suppkey)', 'mean')} FROM lineitem UNION ALL SELECT 'l_linenumber', {r6('avg(l_linenumber)', 'm')} FROM lineitem
        UNION ALL SELECT 'l_quantity', {r6('avg(l_quantity)', 'm')} FROM lineitem UNION ALL SELECT 'l_extendedprice', {r6('avg(l_extendedprice)', 'm')} FROM lineitem
        UNION ALL SELECT 'l_discount', {r6('avg(l_discount)', 'm')} FROM lineitem UNION ALL SELECT 'l_tax', {r6('avg(l_tax)', 'm')} FROM lineitem""",
    )
    def sketched(s, d):
        """Sketches of three partitions, merged, next to exact results: counts as they are, estimates by whether they keep their bound."""
        rows = table(s, d, "lineitem")
        names = ["l_quantity", "l_extendedprice", "l_shipdate"]
        parts = cut_lineage(K.profile_sketches(rows, names, F.col("l_returnflag")))
        got = K.profile_estimates(K.merge_profiles(parts))
        exact = Q.distinct_counts(rows, names)
        around = quantiles(rows, {c: F.col(c).cast("double") for c in names[:2]}, {"low": 0.48, "high": 0.52}).drop("n")
        both = got.join(exact, "feature").join(around, "feature", "left")
        return both.select(
            "feature", "n", "missing", (F.abs(F.col("distinct_estimate") - F.col("distinct_count")) <= 0.06 * F.col("distinct_count")).alias("distinct_holds"),
            F.coalesce(F.col("median").between(F.col("low"), F.col("high")), F.lit(True)).alias("median_holds"))

    r.add(
        "dq_profile_sketches",
        sketched,
        " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS n, count(*) - count({c}) AS missing, true AS distinct_holds, true AS median_holds FROM lineitem"
                           for c in ("l_quantity", "l_extendedprice", "l_shipdate")),
    )
    r.add(
        "pr9_seeded_sample",
        lambda s, d: P.seeded_sample(table(s, d, "orders"), 1000, 42, "o_orderkey"),
        "SELECT * FROM orders ORDER BY substr(md5(concat_ws('|', '42', o_orderkey)), 1, 13), o_orderkey LIMIT 1000",
    )
