"""Run histories derived from the event table: one lineage per event type, one run per day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import temporal as T

from .common import stored, table

# Fixed values, written out here on purpose: thresholds of the metrics below.
REGISTRY = """reg(metric_name, module_, higher, warning, critical) AS (VALUES
  ('overall_error_rate', 'ERROR_FORENSICS', false, 0.15::DOUBLE, 0.30::DOUBLE), ('accuracy', 'PERFORMANCE', true, 0.75::DOUBLE, 0.60::DOUBLE),
  ('psi', 'DRIFT', false, 0.10::DOUBLE, 0.25::DOUBLE), ('flip_rate', 'ROBUSTNESS', false, 0.10::DOUBLE, 0.20::DOUBLE),
  ('null_rate', 'DATA_QUALITY', false, 0.05::DOUBLE, 0.15::DOUBLE))"""

OBS = f"""{REGISTRY}, ev AS (SELECT event_type AS lineage_id, CAST(ts AS DATE) AS d, value, user_id % 5 AS u FROM events),
gl AS (SELECT lineage_id, d, avg((value > 100)::INT) AS er, avg((value >= 20)::INT) AS ac FROM ev GROUP BY 1, 2),
ft AS (SELECT lineage_id, d, u, abs(avg(value) - 50) / 100 AS psi, avg((value > 150)::INT) AS fl, avg((value < 2)::INT) AS nu FROM ev GROUP BY 1, 2, 3),
tall AS (SELECT lineage_id, d, 'ERROR_FORENSICS' AS module, 'overall_error_rate' AS metric_name, 'GLOBAL' AS target_type, 'GLOBAL' AS target_key, er AS v FROM gl
  UNION ALL SELECT lineage_id, d, 'PERFORMANCE', 'accuracy', 'GLOBAL', 'GLOBAL', ac FROM gl
  UNION ALL SELECT lineage_id, d, 'DRIFT', 'psi', 'FEATURE', 'FEATURE::u' || u, psi FROM ft
  UNION ALL SELECT lineage_id, d, 'ROBUSTNESS', 'flip_rate', 'FEATURE', 'FEATURE::u' || u, fl FROM ft
  UNION ALL SELECT lineage_id, d, 'DATA_QUALITY', 'null_rate', 'FEATURE', 'FEATURE::u' || u, nu FROM ft),
rn AS (SELECT lineage_id, d, lineage_id || ':' || d::VARCHAR AS run_id, (row_number() OVER (PARTITION BY lineage_id ORDER BY d) - 1)::INT AS run_index FROM
  (SELECT DISTINCT lineage_id, d FROM ev)),
obs AS (SELECT t.lineage_id, rn.run_id, rn.run_index, t.module, t.metric_name, t.target_type, t.target_key, v, reg.higher,
  CASE WHEN higher AND v <= critical OR NOT higher AND v >= critical THEN 'CRITICAL' WHEN higher AND v <= warning OR NOT higher AND v >= warning THEN 'HIGH' ELSE 'LOW' END AS severity
  FROM tall t JOIN rn USING (lineage_id, d) JOIN reg USING (metric_name)),
pos AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY lineage_id, module, metric_name, target_type, target_key) AS n FROM obs
  WINDOW w AS (PARTITION BY lineage_id, module, metric_name, target_type, target_key ORDER BY run_index))"""
S = "lineage_id, module, metric_name, target_type, target_key"
SPLITS = f"""cand AS (SELECT a.{S.replace(', ', ', a.')}, a.pos AS k, max(a.run_id) AS run_id, max(a.run_index) AS run_index, max(a.n) AS n,
    avg(b.v) FILTER (b.pos < a.pos) AS mb, avg(b.v) FILTER (b.pos >= a.pos) AS ma, var_pop(b.v) FILTER (b.pos < a.pos) AS vb, var_pop(b.v) FILTER (b.pos >= a.pos) AS va
    FROM pos a JOIN pos b USING ({S}) GROUP BY {S}, a.pos)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_type").alias("lineage_id"), F.to_date("ts").alias("d")).distinct()
    return e.select(
        F.concat_ws(":", "lineage_id", F.col("d").cast("string")).alias("run_id"), "lineage_id", F.lit("BASELINE").alias("run_type"),
        F.col("d").cast("timestamp").alias("created_at"), F.concat(F.lit("model-"), F.col("lineage_id")).alias("model_name"),
        F.concat(F.lit("art-"), F.col("lineage_id")).alias("artifact_id"),
    )


def normalized(spark: SparkSession, sf: str) -> DataFrame:
    """Daily metrics in the canonical tall form."""
    e = table(spark, sf, "events").select(
        F.concat_ws(":", "event_type", F.to_date("ts").cast("string")).alias("run_id"), "value", (F.col("user_id") % 5).alias("u"))
    v = F.col("value")
    share = lambda c: F.avg(c.cast("int").cast("double"))
    cell = lambda module, metric, c: F.struct(F.lit(module).alias("module"), F.lit(metric).alias("metric_name"), c.alias("metric_value"))
    g = e.groupBy("run_id").agg(share(v > 100).alias("er"), share(v >= 20).alias("ac"))
    whole = g.select("run_id", F.lit("GLOBAL").alias("target_type"), F.lit("GLOBAL").alias("target_key"), F.inline(F.array(
        cell("ERROR_FORENSICS", "overall_error_rate", F.col("er")), cell("PERFORMANCE", "accuracy", F.col("ac")))))
    f = e.groupBy("run_id", "u").agg((F.abs(F.avg(v) - 50) / 100).alias("psi"), share(v > 150).alias("fl"), share(v < 2).alias("nu"))
    per = f.select("run_id", F.lit("FEATURE").alias("target_type"), F.concat(F.lit("FEATURE::u"), F.col("u").cast("string")).alias("target_key"), F.inline(F.array(
        cell("DRIFT", "psi", F.col("psi")), cell("ROBUSTNESS", "flip_rate", F.col("fl")), cell("DATA_QUALITY", "null_rate", F.col("nu")))))
    return whole.unionByName(per)


def observations(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "observations", lambda: T.extract_observations(normalized(spark, sf), runs(spark, sf)))


def experiments(spark: SparkSession, sf: str) -> DataFrame:
    """One experiment per run on a Monday-like index: conclusions vary with the day."""
    r = T.run_index(runs(spark, sf))
    k = F.col("run_index")
    return r.filter(k % 7 == 3).select(
        F.concat(F.lit("exp-"), F.col("run_id")).alias("experiment_id"), "lineage_id", F.col("run_id").alias("baseline_run_id"),
        F.lit("FEATURE_ABLATION").alias("experiment_type"), F.concat(F.lit("FEATURE::u"), (k % 5).cast("string")).alias("target_key"),
        F.when(k % 2 == 0, F.lit("REJECTED")).otherwise(F.lit("VALIDATED")).alias("conclusion"),
    )


EXPERIMENTS = """ex AS (SELECT 'exp-' || run_id AS experiment_id, lineage_id, run_id AS baseline_run_id, run_index AS base_index, 'FEATURE::u' || (run_index % 5) AS target_key,
  CASE WHEN run_index % 2 = 0 THEN 'REJECTED' ELSE 'VALIDATED' END AS conclusion FROM rn WHERE run_index % 7 = 3)"""
HELD = f"""{EXPERIMENTS}, held AS (SELECT e.experiment_id, e.lineage_id, e.target_key, 'psi' AS metric_name, e.conclusion,
  max(v) FILTER (o.run_index = base_index) AS baseline_value, arg_max(v, o.run_index) FILTER (o.run_index > base_index) AS latest_value,
  count(*) FILTER (o.run_index > base_index) AS followups, count(*) FILTER (o.run_index > base_index AND o.severity IN ('HIGH', 'CRITICAL')) AS regressed
  FROM ex e LEFT JOIN obs o ON o.lineage_id = e.lineage_id AND o.metric_name = 'psi' AND o.target_key = e.target_key GROUP BY ALL),
durab AS (SELECT *, CASE WHEN conclusion <> 'VALIDATED' THEN 'NOT_APPLICABLE' WHEN followups = 0 THEN 'INSUFFICIENT_FOLLOWUP' WHEN regressed = 0 THEN 'SUSTAINED'
  WHEN regressed = followups THEN 'FAILED_TO_SUSTAIN' ELSE 'TEMPORARY' END AS status FROM held)"""
RANK = "CASE {s} WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END"
NAME = "CASE {r} WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END"
# The streak, gap and monotony rules, written with per-row comparisons along the sequence.
TRACKS = f"""tr AS (SELECT lineage_id, target_type, target_key, run_id, run_index, max({RANK.format(s='severity')}) AS r, count(*) AS k FROM obs WHERE target_key <> 'GLOBAL' GROUP BY ALL),
sq AS (SELECT *, row_number() OVER w - 1 AS pos, lag(r) OVER w AS lr, count(*) OVER (PARTITION BY lineage_id, target_key) AS n FROM tr WINDOW w AS (PARTITION BY lineage_id, target_key ORDER BY run_index)),
cu AS (SELECT lineage_id, target_key, max(r) FILTER (pos = n - 1) AS cur, coalesce(max(r) FILTER (pos = n - 2), max(r) FILTER (pos = n - 1)) AS prv FROM sq GROUP BY ALL),
pe AS (SELECT s.lineage_id, s.target_type, s.target_key, max(n) AS n, max(cur) AS cur, max(prv) AS prv, max(r) AS peak, sum(k)::BIGINT AS observations,
  max(n) - 1 - coalesce(max(pos) FILTER (CASE WHEN cur >= 2 THEN r < 2 ELSE r <> cur END), -1) AS streak, count(*) FILTER (r >= 2) AS el,
  bool_and(lr IS NULL OR r > lr) AND max(n) >= 3 AS up, bool_and(lr IS NULL OR r < lr) AND max(n) >= 3 AS down,
  max(pos) FILTER (r >= 2) - min(pos) FILTER (r >= 2) + 1 AS span FROM sq s JOIN cu USING (lineage_id, target_key) GROUP BY 1, 2, 3),
st AS (SELECT *, CASE WHEN up AND cur >= 2 THEN 'ESCALATING' WHEN down AND cur <= 1 THEN 'DEESCALATING' WHEN cur <= 1 AND peak >= 2 AND streak >= 2 THEN 'RECOVERED'
  WHEN cur <= 1 AND peak >= 2 AND el = 1 THEN 'TRANSIENT' WHEN cur >= 2 AND streak >= 3 THEN 'PERSISTENT' WHEN cur >= 2 AND el >= 2 AND span > el THEN 'RECURRING'
  WHEN cur >= 2 AND el <= 2 THEN 'EMERGING' WHEN cur >= 2 THEN 'PERSISTENT' ELSE 'TRANSIENT' END AS status FROM pe)"""
BEST = f"""bk AS (SELECT *, ma - mb AS sh, round(abs(ma - mb) * sqrt(k * (n - k)::DOUBLE / n), 9) AS sc FROM cand WHERE k >= 2 AND n - k >= 2 AND abs(ma - mb) >= 0.05),
cp AS (SELECT *, abs(sh) / sqrt(greatest((vb * k + va * (n - k)) / n, 1e-6)) AS z FROM bk QUALIFY row_number() OVER (PARTITION BY {S} ORDER BY sc DESC, k) = 1)"""
CONF = "CASE WHEN z >= 2.5 OR abs(sh) >= 0.15 THEN 'HIGH' WHEN z >= 1.5 THEN 'MEDIUM' ELSE 'LOW' END"
ALERTS = f"""{OBS}, {SPLITS}, {BEST}, {TRACKS}, {HELD},
facts AS (SELECT lineage_id, target_key, list_sort(list(DISTINCT module)) AS ms, list_sort(list(DISTINCT metric_name)) AS mt FROM obs WHERE target_key <> 'GLOBAL' GROUP BY ALL),
tx AS (SELECT st.*, ms, mt, {NAME.format(r='cur')} AS cs FROM st JOIN facts USING (lineage_id, target_key)),
al AS (SELECT lineage_id, CASE status WHEN 'PERSISTENT' THEN 'PERSISTENT_DEGRADATION' WHEN 'EMERGING' THEN 'NEW_DEGRADATION' WHEN 'ESCALATING' THEN 'ESCALATING_DEGRADATION'
  WHEN 'RECURRING' THEN 'RECURRING_ISSUE' ELSE 'RECOVERY' END AS alert_type, CASE status WHEN 'ESCALATING' THEN 'CRITICAL' WHEN 'RECURRING' THEN 'HIGH' WHEN 'RECOVERED' THEN 'LOW'
  ELSE CASE WHEN cs = 'CRITICAL' THEN 'CRITICAL' ELSE 'HIGH' END END AS priority, target_type, target_key, mt[1] AS metric_name, NULL::DOUBLE AS current_value, NULL::DOUBLE AS reference_value,
  CASE WHEN status IN ('PERSISTENT', 'ESCALATING') THEN 'VERY_HIGH' ELSE 'HIGH' END AS confidence, ms[1] AS source_module FROM tx WHERE status IN ('PERSISTENT', 'EMERGING', 'ESCALATING', 'RECURRING', 'RECOVERED')
  UNION ALL SELECT lineage_id, 'MULTI_MODULE_ESCALATION', 'CRITICAL', target_type, target_key, 'cross_module', NULL, NULL, 'VERY_HIGH', ms[1] FROM tx WHERE len(ms) >= 3 AND cs IN ('HIGH', 'CRITICAL')
  UNION ALL SELECT lineage_id, 'CHANGE_POINT_DETECTED', 'HIGH', target_type, target_key, metric_name, ma, mb, {CONF}, module FROM cp
  UNION ALL SELECT lineage_id, 'REMEDIATION_NOT_SUSTAINED', 'HIGH', 'FEATURE', target_key, metric_name, latest_value, baseline_value, 'HIGH', 'DRIFT' FROM durab WHERE status = 'FAILED_TO_SUSTAIN')"""


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    obs = observations(spark, sf)
    placed = T.run_index(runs(spark, sf))
    build = lambda: T.temporal_alerts(tracks(spark, sf), T.change_point(obs), T.durability(experiments(spark, sf), obs, placed))
    return stored(spark, sf, "temporal_alerts", build)


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "issue_tracks", lambda: T.issue_tracks(observations(spark, sf)))
