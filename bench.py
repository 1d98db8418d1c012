"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

HEADLINE = [
    "robust_zscore_flags", "weekday_band_flags", "ratio_stability_flags", "changepoint_shifts", "population_stability_verdict", "additivity", "fan_out",
    "column_profile", "window_alignment", "name_churn", "orphan_keys", "latest_version", "grain_check", "join_amount_check", "segment_reconcile",
    "keyed_compare_verdict", "restatement_split", "consistency_pairs", "cross_component", "restored_captures", "rank_findings", "lint_model",
    "measure_closure", "check_references", "redact_pii", "residual_scan", "keywords", "tfidf_search", "session_digest"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from checks import QUERIES
    from plumbline import build_session
    spark = build_session("plumbline-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.checkpoint.dir": os.environ.get("BENCH_CHECKPOINTS") or tempfile.mkdtemp(prefix="plumbline-bench-"), "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    timings = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):  # the first run pays for compilation
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - started
            best = took if best is None else min(best, took)
        timings[name] = round(best, 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
