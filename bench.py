"""Headline queries on one machine: one JSON line with seconds per query (median of the runs after a warm-up).

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS`` the timed runs.
Shuffle and spill bytes per query come from the session's own stage records.
"""

import json
import os
import statistics
import sys
import time

from faultlens.bindings import QUERIES
from faultlens.session import build_session

HEADLINES = [
    "d1_log_counts", "c1_pair_intervals", "c3_label_fault_type", "fused_table", "c6_asof_fill", "d3_counter_rate",
    "g10_double_scale", "e2_sliding_windows", "e9_sentinel_batch", "h3_hybrid_score", "f1_top_contributors",
    "d7_class_means", "d12_healthy_percentiles", "d14_threshold_sweep", "d15_calibrate", "d17_curve_points",
    "d24_time_to_detect", "d28_model_comparison", "j1_fit_reconstructor", "j5_stratified_split",
]


def stage_bytes(spark, seen: set) -> tuple[int, int]:
    """Shuffle and spill bytes of the stages that ended since the last call."""
    try:
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    except Exception:
        return -1, -1
    shuffle = spill = 0
    for i in range(stages.size()):
        s = stages.apply(i)
        key = (s.stageId(), s.attemptId())
        if key not in seen:
            seen.add(key)
            shuffle += s.shuffleWriteBytes()
            spill += s.diskBytesSpilled()
    return shuffle, spill


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false", "spark.ui.retainedStages": "100000"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds, shuffled, spilled, seen = {}, {}, {}, set()
    for name in [n for n in (sys.argv[1:] or HEADLINES) if n in QUERIES]:
        times = []
        for run in range(runs + 1):
            stage_bytes(spark, seen)
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if run:
                times.append(time.perf_counter() - start)
        shuffled[name], spilled[name] = stage_bytes(spark, seen)
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name} {seconds[name]}s shuffle {shuffled[name]} spill {spilled[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "shuffle_bytes": shuffled, "spill_bytes": spilled, "cores": int(cpus),
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
