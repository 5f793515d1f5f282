"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "dq_column_profile", "dq2_duplicate_documents", "dq8_iqr_outliers_lines", "lk4_cramers_v", "lk6_mutual_information_binned", "lk8_sample_overlap",
    "dr2_ks_2samp", "dr3_wasserstein", "dr4_numeric_psi", "dr8_drift_severity", "pf4_roc_auc_lines", "pf10_performance_metrics", "pf3_threshold_grid_lines",
    "fr1_group_metrics_lines", "ef4_class_separation", "ef5_mann_whitney", "ef9_top_errors", "rb4_boundary_search", "xp2_global_attribution", "ex2_clip",
    "tm1_extract_observations", "tm4_trend", "tm6_change_point", "tm8_issue_tracks", "nm1_normalize_runs", "cr19_priority_score", "in1_alert_links",
    "in2_incident_clusters", "rl1_trajectory", "ss1_monitor_stream_tumbling",
]


def main() -> None:
    from checks import common, registry
    from plumbline.session import get_spark

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "plumbline-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.log.level": "ERROR",
           "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="plumbline-bench-")},
    )
    found = registry().queries
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        common._STORED.clear()  # every query pays for its own stages
        start = time.perf_counter()
        found[name](spark, sf).collect()
        times[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([\d.]+)", sf)
    print(json.dumps({"metric": "headline queries, total wall clock", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(scale.group(1)) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
