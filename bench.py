"""Time the queries: prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, and
``BENCH_QUERIES`` a comma-separated choice of queries; each is run once to warm up
and timed on the next run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = """
relearn_and_rescore analyze analyze_rgb analyze_tensors level_counts distributions rescored_levels learn_params
fold_reviews review_entries session_metrics review_sessions
global_rank ordered_rank subset split_exact split_by_source batches_shuffled batches_in_order collate
histogram capture_gaps epoch_metrics running_metrics improvements
to_hwc crop resize to_tensor denormalise to_uint8 gray
prepare_dataset write_chunks read_chunks write_frames scan_images score_image_folder scan_feedback parse_capture_name
capture_slots review_sessions_stream score_stream fold_reviews_stream online_params
frame_features source_classifier
""".split()


def main() -> None:
    from roadframes.plans.catalog import QUERIES
    from roadframes.session import build_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        run(name)
        times[name] = round(run(name), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total query time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
