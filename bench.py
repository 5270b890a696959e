"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores.
Each query runs once to warm up and then twice; the faster run counts. Results
are computed in full and thrown away by the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession  # noqa: E402

from streamlens.plans import event_tables  # noqa: E402
from streamlens.plans.registry import all_queries  # noqa: E402

HEADLINE = (
    "frames_base sample_interval sample_percentage sample_immediate sample_at_time"
    " sample_at_times name_frames command_outcome sessions record_sessions recording_task"
    " gap_sessions until_timeout active_task_profile segment_manifest interleave"
    " estimate_frame_rate layout_diff layout_replay mix_on_clock validate_screenshot"
    " validate_mix screenshot_responses request_outcomes"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("streamlens-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="streamlens-bench-"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            # each run measures the width of cells anew, as a first query does
            event_tables.forget()
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
