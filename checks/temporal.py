"""Temporal queries over the event history."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import history_state as H
from plumbline.operators import predicates as P
from plumbline.operators import runs as R
from plumbline.operators import temporal as T
from plumbline.streaming.run import work_folder

from .common import Registry, r6, rounded
from .history import (ALERTS, BEST, CONF, EXPERIMENTS, HELD, NAME, OBS, S, SPLITS, TRACKS, alerts, experiments, observations, runs)


def modules(s, d):
    """Module rows per run with statuses that follow from the run's day."""
    r = T.run_index(runs(s, d))
    names = ["DRIFT", "PERFORMANCE", "ROBUSTNESS", "BIAS"]
    k = F.col("run_index")
    rows = r.select("run_id", "run_index", F.posexplode(F.array(*[F.lit(n) for n in names])).alias("i", "module"))
    status = (
        F.when(k % 5 == 0, F.lit("FAILED")).when((k % 5 == 1) & (F.col("i") == 0), F.lit("FAILED")).when((k % 5 == 2) & (F.col("i") <= 1), F.lit("RUNNING"))
        .when((k % 5 == 3) & (F.col("i") == 3), F.lit("SKIPPED")).otherwise(F.lit("COMPLETED"))
    )
    return rows.select("run_id", "module", status.alias("status"))


MODULES = """md AS (SELECT run_id, i, CASE WHEN run_index % 5 = 0 THEN 'FAILED' WHEN run_index % 5 = 1 AND i = 0 THEN 'FAILED' WHEN run_index % 5 = 2 AND i <= 1 THEN 'RUNNING'
  WHEN run_index % 5 = 3 AND i = 3 THEN 'SKIPPED' ELSE 'COMPLETED' END AS status FROM rn, (SELECT unnest(range(0, 4)) AS i) z),
mc AS (SELECT run_id, count(*) AS modules, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed,
  count(*) FILTER (status = 'SKIPPED') AS skipped, count(*) FILTER (status = 'RUNNING') AS running FROM md GROUP BY 1),
ms AS (SELECT *, CASE WHEN completed + skipped = modules THEN 'COMPLETED' WHEN failed + skipped = modules THEN 'FAILED' WHEN completed + failed + skipped = modules THEN 'PARTIAL'
  WHEN running > 0 OR completed + failed > 0 THEN 'RUNNING' ELSE 'PENDING' END AS status FROM mc)"""


def statuses(s, d):
    return R.run_status(modules(s, d)).join(runs(s, d), "run_id").select("run_id", "status", "lineage_id", F.col("created_at").alias("started_at"))


_APPENDED: dict[tuple, H.HistoryState] = {}


def appended(s, d):
    """The state of all runs: the first half of the indices, then all but the last run, then the last."""
    key = (s.sparkContext.applicationId, d)
    if key not in _APPENDED:
        obs, folder = observations(s, d), work_folder(s, "history")
        last = obs.agg(F.max("run_index").alias("last")).first()["last"] or 0
        state = H.empty_history(s)
        for batch, upto in enumerate((last // 2, last - 1, last), 1):
            # Known runs are passed over.
            H.add_runs(state, obs.filter(F.col("run_index") <= upto)).save(folder)
            state = H.load_history(s, folder, batch)
        _APPENDED[key] = state
    return _APPENDED[key]


def register(r: Registry) -> None:
    r.add(
        "tm1_extract_observations",
        lambda s, d: rounded(observations(s, d).select("lineage_id", "run_id", "run_index", "module", "metric_name", "target_type", "target_key", "metric_value", "severity")),
        f"WITH {OBS} SELECT lineage_id, run_id, run_index::BIGINT AS run_index, module, metric_name, target_type, target_key, {r6('v', 'metric_value')}, severity FROM obs",
    )
    r.add(
        "tm2_grade",
        lambda s, d: observations(s, d).groupBy("metric_name", "severity").agg(F.count(F.lit(1)).alias("n")),
        f"WITH {OBS} SELECT metric_name, severity, count(*) AS n FROM obs GROUP BY 1, 2",
    )
    hist = f"""hi AS (SELECT {S}, max(n) AS n, avg(v) AS mean, quantile_cont(v, 0.5) AS median, stddev_pop(v) AS sd, min(v) AS mn, max(v) AS mx, max(v) FILTER (pos = n - 1) AS latest,
        coalesce(max(v) FILTER (pos = n - 2), max(v) FILTER (pos = n - 1)) AS prev, avg(v) FILTER (pos < greatest(1, least(5, n // 2))) AS bm,
        stddev_pop(v) FILTER (pos < greatest(1, least(5, n // 2))) AS bs FROM pos GROUP BY {S})"""
    r.add(
        "tm3_metric_history",
        lambda s, d: rounded(T.metric_history(observations(s, d)), 5),
        f"""WITH {OBS}, {hist} SELECT {S}, n, """ + ", ".join(f"round({e} + 2e-9, 5) + 0.0 AS {n}" for e, n in (
            ("mean", "mean"), ("median", "median"), ("sd", "std"), ("CASE WHEN abs(mean) > 1e-6 THEN sd / abs(mean) ELSE 0 END", "cv"), ("mn", "min"), ("mx", "max"),
            ("latest", "latest"), ("prev", "previous"), ("latest - prev", "delta"), ("(latest - prev) / greatest(abs(prev), 1e-6)", "relative_delta"),
            ("bm", "baseline_mean"), ("bs", "baseline_std"), ("CASE WHEN bs > 1e-6 THEN (latest - bm) / bs ELSE 0 END", "standardized_latest"))) + " FROM hi",
    )
    r.add(
        "wn2_baseline_window",
        lambda s, d: rounded(T.metric_history(observations(s, d)).select(*T.SERIES, "baseline_mean", "baseline_std")),
        f"WITH {OBS}, {hist} SELECT {S}, {r6('bm', 'baseline_mean')}, {r6('bs', 'baseline_std')} FROM hi",
    )
    r.add(
        "wn1_series_deltas",
        lambda s, d: rounded(T.series_deltas(observations(s, d)).drop("relative_delta")),
        f"""WITH {OBS}, l AS (SELECT {S}, run_index, v, lag(v) OVER (PARTITION BY {S} ORDER BY run_index) AS pv FROM obs)
        SELECT {S}, run_index::BIGINT AS run_index, {r6('v', 'metric_value')}, {r6('pv', 'previous_value')}, {r6('v - pv', 'delta')} FROM l""",
    )
    tr = f"""tn AS (SELECT {S}, max(n) AS n, coalesce(regr_slope(v, pos), 0) AS sl, CASE WHEN max(v) > min(v) THEN regr_r2(v, pos) ELSE 0 END AS r2, avg(v) AS m, stddev_pop(v) AS sd,
        max(v) - min(v) AS sp, bool_or(higher) AS h FROM pos GROUP BY {S}), td AS (SELECT *, CASE WHEN n < 3 THEN 'INSUFFICIENT_DATA'
        WHEN CASE WHEN abs(m) > 1e-6 THEN sd / abs(m) ELSE 0 END > 0.3 AND r2 < 0.25 AND sp > 0.1 THEN 'VOLATILE'
        WHEN CASE WHEN h THEN sl ELSE -sl END > 0.005 THEN 'IMPROVING' WHEN CASE WHEN h THEN sl ELSE -sl END < -0.005 THEN 'DEGRADING' ELSE 'STABLE' END AS dir FROM tn)"""
    r.add("tm4_trend", lambda s, d: rounded(T.trend(observations(s, d))),
          f"WITH {OBS}, {tr} SELECT {S}, n, {r6('sl', 'slope')}, {r6('r2', 'r2')}, dir AS direction FROM td")
    mk = f"""vr AS (SELECT {S}, pos, round(v, 9) AS v, n FROM pos), pr AS (SELECT a.{S.replace(', ', ', a.')}, sum(sign(b.v - a.v))::BIGINT AS s FROM vr a JOIN vr b USING ({S}) WHERE a.pos < b.pos GROUP BY {S}),
        ti AS (SELECT {S}, max(n) AS n, sum(t * (t - 1) * (2 * t + 5)) AS ties FROM (SELECT {S}, v, max(n) AS n, count(*) AS t FROM vr GROUP BY {S}, v) z GROUP BY {S}),
        mk AS (SELECT {S}, n, s, 2.0::DOUBLE * s / (n * (n - 1)) AS tau, (s - sign(s)) / sqrt(greatest((n * (n - 1) * (2 * n + 5) - ties) / 18.0::DOUBLE, 1e-9)) AS z FROM ti JOIN pr USING ({S}))"""
    r.add(
        "tm5_mann_kendall",
        lambda s, d: rounded(T.mann_kendall(observations(s, d)).drop("p", "trend")),
        f"WITH {OBS}, {mk} SELECT {S}, n, s, {r6('tau', 'tau')}, {r6('z', 'z')} FROM mk",
    )
    r.add(
        "tm5_mann_kendall_trend",
        lambda s, d: T.mann_kendall(observations(s, d)).select(*T.SERIES, "trend"),
        f"""WITH {OBS}, {mk} SELECT {S}, CASE WHEN abs(z) > 1.959963984540054 AND s > 0 THEN 'INCREASING' WHEN abs(z) > 1.959963984540054 AND s < 0 THEN 'DECREASING' ELSE 'NO_TREND' END AS trend FROM mk""",
    )
    r.add(
        "tm6_change_point",
        lambda s, d: rounded(T.change_point(observations(s, d)), 5),
        f"""WITH {OBS}, {SPLITS}, {BEST} SELECT {S}, k AS change_index, run_id, run_index::BIGINT AS run_index, round(mb + 2e-9, 5) + 0.0 AS before_mean, round(ma + 2e-9, 5) + 0.0 AS after_mean,
        round(sh + 2e-9, 5) + 0.0 AS shift, round(sh / greatest(abs(mb), 1e-6) + 2e-9, 5) + 0.0 AS relative_shift, round(z + 2e-9, 5) + 0.0 AS z, {CONF} AS confidence FROM cp""",
    )
    r.add(
        "wn3_split_means",
        lambda s, d: rounded(T.split_means(observations(s, d))),
        f"WITH {OBS}, {SPLITS} SELECT {S}, run_index::BIGINT AS run_index, k AS pos, {r6('mb', 'before_mean')}, {r6('ma', 'after_mean')} FROM cand",
    )
    r.add(
        "tm7_persistence",
        lambda s, d: rounded(T.persistence(T.target_runs(observations(s, d)))),
        f"""WITH {OBS}, {TRACKS} SELECT lineage_id, target_type, target_key, n AS runs, {NAME.format(r='cur')} AS current_severity, {NAME.format(r='prv')} AS previous_severity,
        {NAME.format(r='peak')} AS peak_severity, streak AS consecutive, el AS elevated_runs, status FROM st""",
    )
    r.add(
        "wn4_severity_transitions",
        lambda s, d: rounded(T.severity_transitions(T.target_runs(observations(s, d)))),
        f"""WITH {OBS}, {TRACKS} SELECT lineage_id, target_type, target_key, run_index::BIGINT AS run_index, {NAME.format(r='lr')} AS from_severity, {NAME.format(r='r')} AS to_severity
        FROM sq WHERE lr <> r""",
    )
    r.add(
        "tm8_issue_tracks",
        lambda s, d: rounded(T.issue_tracks(observations(s, d)).withColumns({"modules": F.concat_ws("|", "modules"), "metrics": F.concat_ws("|", "metrics")})
                             .drop("previous_severity", "elevated_runs")),
        f"""WITH {OBS}, {TRACKS}, fa AS (SELECT lineage_id, target_key, min(run_index)::BIGINT AS first_run_index, max(run_index)::BIGINT AS last_run_index, arg_min(run_id, run_index) AS first_run_id,
        arg_max(run_id, run_index) AS last_run_id, string_agg(DISTINCT module, '|' ORDER BY module) AS modules, string_agg(DISTINCT metric_name, '|' ORDER BY metric_name) AS metrics
        FROM obs WHERE target_key <> 'GLOBAL' GROUP BY ALL) SELECT lineage_id, target_type, target_key, first_run_index, last_run_index, first_run_id, last_run_id, observations, modules, metrics,
        n AS runs, {NAME.format(r='cur')} AS current_severity, {NAME.format(r='peak')} AS peak_severity, streak AS consecutive, status FROM st JOIN fa USING (lineage_id, target_key)""",
    )

    # The same results from a state to which the runs are added in three parts.
    for name, build in {
        "tm3_metric_history": lambda h: rounded(h.metric_history(), 5),
        "tm4_trend": lambda h: rounded(h.trend()),
        "tm5_mann_kendall": lambda h: rounded(h.mann_kendall().drop("p", "trend")),
        "tm6_change_point": lambda h: rounded(h.change_point(), 5),
        "tm7_persistence": lambda h: rounded(h.persistence()),
    }.items():
        r.add(f"{name}_appended", lambda s, d, build=build: build(appended(s, d)), r.sql[name])

    def pair(s, d):
        o = observations(s, d)
        pick = lambda m: o.filter(F.col("metric_name") == m).select("lineage_id", "target_key", "run_index", "metric_value")
        return pick("psi"), pick("flip_rate")

    r.add(
        "tm9_lag_correlation",
        lambda s, d: rounded(T.lag_correlation(*pair(s, d), keys=["lineage_id", "target_key"]).drop("p")),
        f"""WITH {OBS}, pr AS (SELECT a.lineage_id, a.target_key, g.lag, a.v AS x, b.v AS y FROM pos a, (SELECT unnest([0, 1, 2]) AS lag) g, pos b
        WHERE a.metric_name = 'psi' AND b.metric_name = 'flip_rate' AND a.lineage_id = b.lineage_id AND a.target_key = b.target_key AND b.pos = a.pos + g.lag AND b.pos < least(a.n, b.n)
        AND least(a.n, b.n) >= 4 AND g.lag < least(a.n, b.n) - 2), c AS (SELECT lineage_id, target_key, lag, count(*) AS pairs, corr(x, y) AS r, stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM pr GROUP BY ALL)
        SELECT lineage_id, target_key, lag::BIGINT AS lag, pairs, {r6('r', 'r')}, CASE WHEN abs(r) >= 0.7 THEN 'STRONG' ELSE 'MODERATE' END AS strength FROM c
        WHERE pairs >= 3 AND sx >= 1e-6 AND sy >= 1e-6 AND abs(r) >= 0.4""",
    )
    r.add(
        "tm10_durability",
        lambda s, d: rounded(T.durability(experiments(s, d), observations(s, d), T.run_index(runs(s, d)))),
        f"""WITH {OBS}, {HELD} SELECT experiment_id, lineage_id, target_key, metric_name, conclusion, {r6('baseline_value', 'baseline_value')}, {r6('latest_value', 'latest_value')},
        followups, regressed, status FROM durab""",
    )
    r.add(
        "tm11_temporal_alerts",
        lambda s, d: rounded(alerts(s, d), 5),
        f"""WITH {ALERTS} SELECT lineage_id, alert_type, priority, target_type, target_key, metric_name, round(current_value + 2e-9, 5) + 0.0 AS current_value, round(reference_value + 2e-9, 5) + 0.0 AS reference_value,
        confidence, source_module FROM al""",
    )

    def ids(s, d):
        r_ = runs(s, d)
        return (r_.select(F.col("run_id").alias("id")).unionByName(r_.select(F.col("artifact_id").alias("id")))
                .unionByName(r_.select(F.col("model_name").alias("id"))).unionByName(r_.select(F.concat(F.lit("x-"), "run_id").alias("id"))).distinct())

    r.add(
        "tm12_resolve_lineage",
        lambda s, d: T.resolve_lineage(ids(s, d), runs(s, d)),
        f"""WITH {OBS} SELECT run_id AS id, lineage_id, 'RUN' AS matched_by FROM rn UNION SELECT 'art-' || lineage_id, lineage_id, 'ARTIFACT' FROM rn
        UNION SELECT 'model-' || lineage_id, lineage_id, 'MODEL' FROM rn UNION SELECT 'x-' || run_id, NULL, NULL FROM rn""",
    )

    def typed(s, d):
        k = F.col("run_index")
        return T.run_index(runs(s, d)).withColumn("run_type", F.when(k % 6 == 5, F.lit("EXPERIMENT")).otherwise(F.lit("BASELINE")))

    r.add(
        "tm13_history_summary",
        lambda s, d: T.history_summary(typed(s, d), T.issue_tracks(observations(s, d)), alerts(s, d)),
        f"""WITH {ALERTS}, a AS (SELECT lineage_id, count(*) AS runs, count(*) FILTER (run_index % 6 <> 5) AS baseline_runs, count(*) FILTER (run_index % 6 = 5) AS experiment_runs FROM rn GROUP BY 1),
        b AS (SELECT lineage_id, count(*) FILTER (cur >= 2) AS active_issues, count(*) FILTER (status = 'PERSISTENT') AS persistent_issues, count(*) FILTER (status = 'EMERGING') AS emerging_issues,
        count(*) FILTER (status = 'RECURRING') AS recurring_issues FROM st GROUP BY 1), c AS (SELECT lineage_id, count(*) FILTER (priority = 'CRITICAL') AS critical_alerts FROM al GROUP BY 1)
        SELECT a.*, coalesce(active_issues, 0) AS active_issues, coalesce(persistent_issues, 0) AS persistent_issues, coalesce(emerging_issues, 0) AS emerging_issues,
        coalesce(recurring_issues, 0) AS recurring_issues, coalesce(critical_alerts, 0) AS critical_alerts FROM a LEFT JOIN b USING (lineage_id) LEFT JOIN c USING (lineage_id)""",
    )
    r.add(
        "tm14_timeline",
        lambda s, d: T.timeline(runs(s, d), modules(s, d)),
        f"""WITH {OBS}, {MODULES} SELECT lineage_id, run_id, 'BASELINE' AS run_type, d::TIMESTAMP AS created_at, modules, completed, failed FROM rn JOIN mc USING (run_id)""",
    )
    r.add(
        "pr7_baseline_runs",
        lambda s, d: P.baseline_runs(typed(s, d)).groupBy("lineage_id").agg(F.count(F.lit(1)).alias("n")),
        f"WITH {OBS} SELECT lineage_id, count(*) AS n FROM rn WHERE run_index % 6 <> 5 GROUP BY 1",
    )
    r.add(
        "pr8_last_n_runs",
        lambda s, d: P.last_n_runs(typed(s, d), 5).select("lineage_id", "run_id"),
        f"WITH {OBS} SELECT lineage_id, run_id FROM rn QUALIFY row_number() OVER (PARTITION BY lineage_id ORDER BY run_index DESC) <= 5",
    )
    r.add(
        "rn1_run_status",
        lambda s, d: R.run_status(modules(s, d)),
        f"WITH {OBS}, {MODULES} SELECT * FROM ms",
    )
    stamp = "2024-01-20 12:00:00"
    r.add(
        "rn2_stale_runs",
        lambda s, d: R.stale_runs(statuses(s, d), F.lit(stamp).cast("timestamp")).select("run_id"),
        f"WITH {OBS}, {MODULES} SELECT run_id FROM ms JOIN rn USING (run_id) WHERE status = 'RUNNING' AND d::TIMESTAMP < TIMESTAMP '{stamp}' - INTERVAL 15 MINUTE",
    )
    r.add(
        "rn3_run_progress",
        lambda s, d: rounded(R.run_progress(statuses(s, d), modules(s, d))),
        f"""WITH {OBS}, {MODULES} SELECT run_id, status, modules, completed, failed, skipped, running,
        CASE WHEN status IN ('COMPLETED', 'FAILED', 'PARTIAL') THEN 100 ELSE round((completed + failed + skipped)::DOUBLE * 100 / modules, 1) END AS percent FROM ms""",
    )
    _ = EXPERIMENTS
