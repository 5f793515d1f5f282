"""Streaming queries over the event file, and source / sink round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.sources import tables as S
from plumbline.streaming.alerts import alert_stream
from plumbline.streaming.labels import delayed_error_rates, labelled_stream
from plumbline.streaming.monitor import monitor_stream, score_shares
from plumbline.streaming.run import run_available, work_folder

from .common import Registry, r6, rounded, table
from .performance import EDGES


def events_stream(s, d):
    schema = table(s, d, "events").schema
    return s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def monitored(s, d, window, slide=None):
    p = F.least(F.col("value") / 100, F.lit(1.0))
    y = (F.col("event_type") == "error").cast("int")
    shares = score_shares(table(s, d, "events").filter("ts < '2024-01-08'"), p)
    out = monitor_stream(events_stream(s, d), "ts", y, p, window, slide, "1 day", baseline_shares=shares)
    return run_available(out, "monitor").withColumns({c: F.col(c).cast("string") for c in ("window_start", "window_end")})


BINS = f"""ev AS (SELECT ts, (event_type = 'error')::INT AS y, least(value / 100, 1.0::DOUBLE) AS p FROM events),
eb AS (SELECT *, least(len(list_filter({EDGES}, lambda e: e <= p)), 10) - 1 AS b FROM ev),
base AS (SELECT k, (SELECT count(*) FROM eb WHERE ts < TIMESTAMP '2024-01-08' AND b = k)::DOUBLE / (SELECT count(*) FROM eb WHERE ts < TIMESTAMP '2024-01-08') AS share FROM (SELECT unnest(range(0, 10)) AS k))"""


def register(r: Registry) -> None:
    agg = """wn AS (SELECT ws, we, count(*) AS n, count(*) FILTER ((p >= 0.5)::INT <> y) AS errors, avg(p) AS mp, avg(y) AS pr FROM wi GROUP BY 1, 2),
        wb AS (SELECT ws, k, count(*) FILTER (b = k) AS c, coalesce(sum(p - y) FILTER (b = k), 0) AS g, max(share) AS share, count(*) AS t FROM wi, base GROUP BY 1, 2),
        wm AS (SELECT ws, sum(abs(g)) / max(t) AS ece, sum(((c + 1e-4) / (t + 1e-3) - (share + 1e-4) / (1 + 1e-3)) * ln(((c + 1e-4) / (t + 1e-3)) / ((share + 1e-4) / (1 + 1e-3)))) AS psi FROM wb GROUP BY 1)
        SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(we, '%Y-%m-%d %H:%M:%S') AS window_end, n, errors, """ + f"{r6('errors::DOUBLE / n', 'error_rate')}, {r6('mp', 'mean_p')}, {r6('pr', 'positive_rate')}, {r6('ece', 'ece')}, {r6('psi', 'psi')} FROM wn JOIN wm USING (ws) WHERE we <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY"
    r.add(
        "ss1_monitor_stream_tumbling",
        lambda s, d: rounded(monitored(s, d, "1 day")),
        f"WITH {BINS}, wi AS (SELECT *, date_trunc('day', ts) AS ws, date_trunc('day', ts) + INTERVAL 1 DAY AS we FROM eb), {agg}",
    )
    r.add(
        "ss1_monitor_stream_sliding",
        lambda s, d: rounded(monitored(s, d, "2 days", "1 day")),
        f"""WITH {BINS}, wi AS (SELECT *, date_trunc('day', ts) AS ws, date_trunc('day', ts) + INTERVAL 2 DAY AS we FROM eb UNION ALL
        SELECT *, date_trunc('day', ts) - INTERVAL 1 DAY, date_trunc('day', ts) + INTERVAL 1 DAY FROM eb), {agg}""",
    )

    def delayed(s, d):
        """Labels come (event_id % 200) hours after their event, none for every seventh; five days are waited for."""
        ev = events_stream(s, d)
        preds = ev.select("event_id", "ts", (F.col("value") >= 50).cast("int").alias("predicted"))
        labels = events_stream(s, d).filter("event_id % 7 <> 0").select(
            "event_id", (F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 200).cast("int"))).alias("label_ts"), (F.col("event_type") == "error").cast("int").alias("label"))
        rows = run_available(labelled_stream(preds, labels, "event_id", "ts", "label_ts", "label", "5 days"), "labelled")
        out = delayed_error_rates(rows, "ts", "label", F.col("predicted"))
        return rounded(out.withColumns({c: F.col(c).cast("string") for c in ("window_start", "window_end")}))

    r.add(
        "ss1_delayed_labels",
        delayed,
        f"""WITH ev AS (SELECT event_id, ts, (value >= 50)::INT AS predicted, (event_type = 'error')::INT AS y, event_id % 7 <> 0 AND event_id % 200 <= 120 AS comes FROM events),
        seen AS (SELECT * FROM ev WHERE comes OR ts + INTERVAL 5 DAY < (SELECT max(ts) FROM events) - INTERVAL 1 DAY)
        SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
        count(*) AS n, count(*) FILTER (comes) AS labelled, count(*) FILTER (comes AND predicted <> y) AS errors,
        {r6('(count(*) FILTER (comes AND predicted <> y))::DOUBLE / nullif(count(*) FILTER (comes), 0)', 'error_rate')} FROM seen GROUP BY 1, 2""",
    )

    def lifecycle(s, d):
        v = F.col("value")
        sev = F.when(v > 120, F.lit("CRITICAL")).when(v > 60, F.lit("HIGH")).when(v > 20, F.lit("MEDIUM"))
        rows = events_stream(s, d).select(
            F.concat_ws("::", "event_type", (F.col("user_id") % 50).cast("string")).alias("fingerprint"), "ts", sev.alias("severity"),
            F.when(F.col("event_id") % 25 == 0, F.lit(12.0)).alias("suppress_hours"))
        return run_available(alert_stream(rows), "alerts").groupBy("event").agg(F.count(F.lit(1)).alias("n"))

    r.add("ss2_alert_stream", lifecycle)

    # -- sources and sinks: write the whole table in a format, read it back, compare
    def round_trip(s, d, fmt):
        base = work_folder(s, "io")
        src = table(s, d, "customer")
        if fmt == "csv":
            src.write.option("header", True).csv(f"{base}/t.csv")
            return S.load_table(s, f"file://{base}/t.csv" if base.startswith("/") else f"{base}/t.csv")
        if fmt == "json":
            src.write.option("lineSep", "\n").json(f"{base}/t.jsonl")
            return S.load_table(s, f"{base}/t.jsonl")
        src.write.parquet(f"{base}/t.pq")
        return S.load_table(s, f"{base}/t.pq")

    sums = f"SELECT count(*) AS n, sum(c_custkey)::BIGINT AS k, {r6('sum(c_acctbal)', 'balance', 2)}, count(DISTINCT c_mktsegment) AS segments FROM customer"
    for fmt in ("csv", "json", "parquet"):
        r.add(f"io1_load_table_{fmt}", lambda s, d, f=fmt: rounded(round_trip(s, d, f).agg(
            F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("k"), F.sum("c_acctbal").alias("balance"), F.count_distinct("c_mktsegment").alias("segments")), 2), sums)

    def pair(s, d):
        ev, base, reason = S.load_pair(s, f"{d}/orders.parquet", f"{d}/customer.parquet")
        assert reason is None
        return S.side_by_side(ev, base).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.count("o_orderkey").alias("orders"), F.count("c_custkey").alias("customers"))

    r.add("io2_load_pair", pair, "SELECT 'eval' AS side, count(*) AS n, count(*) AS orders, 0::BIGINT AS customers FROM orders UNION ALL SELECT 'base', count(*), 0, count(*) FROM customer")

    def absent(s, d):
        ev, base, reason = S.load_pair(s, f"{d}/orders.parquet", f"{d}/no_such_table.parquet")
        return ev.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(base is None).alias("no_baseline"), F.lit(reason is not None).alias("explained"))

    r.add("io2_missing_baseline", absent, "SELECT count(*) AS n, true AS no_baseline, true AS explained FROM orders")

    def candidate(s, d):
        from plumbline.operators.experiments import ablate

        path = S.write_candidate(ablate(table(s, d, "lineitem"), "l_tax", "zero"), work_folder(s, "candidate"), "lineitem_no_tax", {"source": "lineitem", "transform": "zero l_tax"})
        return rounded(S.load_table(s, path).agg(F.count(F.lit(1)).alias("n"), F.sum("l_tax").alias("tax"), F.sum("l_quantity").alias("quantity")), 2)

    r.add("io3_write_candidate", candidate, f"SELECT count(*) AS n, {r6('0', 'tax', 2)}, {r6('sum(l_quantity)', 'quantity', 2)} FROM lineitem")

    def twice(s, d):
        folder = work_folder(s, "partitions")
        rows = table(s, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderpriority").alias("run_id"))
        S.write_partition(rows, folder)
        S.write_partition(rows.filter("run_id = '1-URGENT'").withColumn("o_totalprice", F.lit(1.0)), folder)
        return rounded(s.read.parquet(folder).groupBy(F.col("run_id").cast("string").alias("run_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2)

    r.add(
        "io4_write_partition",
        twice,
        f"SELECT o_orderpriority AS run_id, count(*) AS n, {r6(f'''CASE WHEN o_orderpriority = '1-URGENT' THEN count(*) ELSE sum(o_totalprice) END''', 'total', 2)} FROM orders GROUP BY 1",
    )
