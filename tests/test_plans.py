"""What the physical plans must and must not contain once nothing is small enough to broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from streamlens.plans.registry import all_queries

SF = "/root/testdata/sf0.001"
BATCH = [n for n in all_queries() if not n.startswith("stream_")]


@pytest.fixture
def large(spark):
    """Plans as for large tables: no broadcast by size, and no change while running."""
    for name, value in (("autoBroadcastJoinThreshold", "-1"), ("adaptive.enabled", "false")):
        spark.conf.set(f"spark.sql.{name}", value)
    yield spark
    for name in ("autoBroadcastJoinThreshold", "adaptive.enabled"):
        spark.conf.unset(f"spark.sql.{name}")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_product_and_no_single_task(large, name):
    plan = plan_of(all_queries()[name](large, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastHashJoin", "BatchEvalPython"):
        assert bad not in plan
    singles = re.findall(r"Exchange SinglePartition", plan)
    # Only the totals of cells, one row each, are summed in one sequence.
    assert len(singles) == (1 if name == "active_task_profile" else 0)


@pytest.mark.parametrize(
    "name", ["command_outcome", "sessions", "record_sessions", "record_methods", "gap_sessions", "until_timeout",
             "interleave", "name_frames", "sample_at_times", "screenshot_responses"]
)
def test_windows_over_rows_stay_in_cells(large, name):
    """A window works inside a cell or on summaries, in the order of cells or in none."""
    plan = plan_of(all_queries()[name](large, SF))
    windows = re.findall(r"windowspecdefinition\(([^)]*?specifiedwindowframe)", plan)
    assert windows
    assert all("_cell" in w for w in windows if "NULLS" in w)


def test_runs_and_their_summary_share_one_shuffle(large):
    plan = plan_of(all_queries()["gap_sessions"](large, SF))
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_kept_cells_save_shuffles(large):
    """Rows are shuffled once for their origin, their routing and their numbers."""
    plan = plan_of(all_queries()["interleave"](large, SF))
    rows = plan.split("Exchange")[0]
    assert rows.count("SortMergeJoin") == 3


@pytest.mark.parametrize("name", BATCH)
def test_no_window_reaches_forward_to_the_end(large, name):
    """Such frames are computed anew for each row: quadratic time."""
    plan = plan_of(all_queries()[name](large, SF))
    frames = re.findall(r"specifiedwindowframe\(RowFrame, ([^,]*), ([^)]*\))", plan)
    assert all("unboundedpreceding" in a for a, b in frames if "unboundedfollowing" in b)


def test_only_needed_columns_are_read(large):
    plan = plan_of(all_queries()["sample_interval"](large, SF))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas
    for columns in schemas:
        assert "props" not in columns and "value" not in columns
    assert "In(event_type, [click,view])" in plan or "In(event_type, [view,click])" in plan


def test_first_frames_are_cut_before_the_shuffle(large):
    plan = plan_of(all_queries()["sample_immediate"](large, SF))
    assert plan.count("WindowGroupLimit") == 2


def test_counts_are_combined_before_the_shuffle(large):
    for name in ("probe_streams", "request_outcomes", "media_inventory"):
        assert "partial_" in plan_of(all_queries()[name](large, SF))


def test_payload_is_not_part_of_sampling(large):
    from streamlens.operators.sampling import sample_interval

    frames = large.range(10).select(
        F.col("id").alias("stream_id"), F.col("id").alias("frame_id"),
        F.col("id").cast("double").alias("t"), F.lit(b"x").alias("data"),
    )
    assert "data" not in plan_of(sample_interval(frames, 1)).split("Range")[0]


def counted(plan):
    return plan.count("FileScan"), plan.count("Exchange hashpartitioning")


@pytest.mark.parametrize(
    "name, scans, shuffles",
    [("route_media", 2, 4), ("interleave", 4, 11), ("segment_manifest", 4, 15), ("recording_task", 2, 2),
     ("recording_rates", 3, 6), ("recording_methods_task", 2, 3)],
)
def test_reads_and_shuffles(large, name, scans, shuffles):
    """Recordings are written once by cell; choosing their streams and rates shuffles summaries only."""
    reads, exchanges = counted(plan_of(all_queries()[name](large, SF)))
    assert reads <= scans and exchanges <= shuffles


def test_recorded_packets_are_not_shuffled_again(large):
    """All rows come from buckets; what is shuffled has one row for each cell."""
    plan = plan_of(all_queries()["recording_task"](large, SF))
    assert plan.count("Bucketed: true") == 2
    below = [part.split("+- ")[1] for part in plan.split("Exchange hashpartitioning")[1:]]
    assert all("Aggregate" in part or "Project" in part for part in below)


def test_only_wanted_payload_is_shuffled(spark):
    """Marks are looked up in the scan's own stage; what passes them is little more than what is kept."""
    from streamlens.sinks.frames import attach_payload, marked

    frames = spark.range(200_000).select(
        (F.col("id") % 3).alias("stream_id"), F.col("id").alias("frame_id"),
        F.repeat(F.lit("x"), 100).alias("data"),
    )
    kept = frames.filter("frame_id % 500 = 7").select(
        F.col("stream_id").cast("int").alias("stream_id"), "frame_id", F.lit(1.5).alias("t")
    )
    passed = marked(kept, frames)
    assert passed.join(kept, ["stream_id", "frame_id"], "left_semi").count() == 400
    assert passed.count() < 420
    crowded = marked(kept, frames, marks=256)
    assert crowded.join(kept, ["stream_id", "frame_id"], "left_semi").count() == 400
    got = attach_payload(kept, frames, "data")
    assert sorted(r["frame_id"] for r in got.select("frame_id").collect()) == list(range(7, 200_000, 500))
    assert got.columns == ["stream_id", "frame_id", "t", "data"]
    assert attach_payload(kept.limit(0), frames, "data").isEmpty()


def test_payload_meets_its_marks_before_any_shuffle(large):
    from streamlens.sinks.frames import attach_payload

    events = large.read.parquet(f"{SF}/events.parquet").select(
        F.col("user_id").alias("stream_id"), F.col("event_id").alias("frame_id"), "props"
    )
    plan = plan_of(attach_payload(events.select("stream_id", "frame_id").filter("frame_id % 50 = 1"), events, "props"))
    # the branch that carries the payload, from its shuffle down to its file
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "props" in line)
    above = [line for line in lines[:scan]]
    shuffle = max(i for i, line in enumerate(above) if "Exchange hashpartitioning(stream_id" in line)
    assert any("BroadcastHashJoin" in line for line in above[shuffle:])
