"""Whole jobs: from frames, commands and requests to what is written."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from streamlens.operators import layout, recording
from streamlens.plans import mixer, recorder, screenshot
from streamlens.sinks.recorders import register_recorder
from streamlens.sources.frames import to_frames

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def frames(spark):
    rows = [
        (s, s * 1000 + n, START + timedelta(seconds=n * 0.5), ("video", "audio", "data")[n % 3], n % 6 == 0,
         bytes([s, n]))
        for s in (1, 2)
        for n in range(60)
    ]
    df = spark.createDataFrame(
        rows, "stream_id bigint, frame_id bigint, ts timestamp_ntz, media string, is_key boolean, data binary"
    )
    return to_frames(df, cell_seconds=7).withColumn("dts", F.col("pts")).cache()


def test_screenshots_end_to_end(spark, frames, tmp_path):
    named = screenshot.screenshots(frames, "interval", interval=10, dir="d", prefix="p", cell_seconds=7)
    screenshot.save_screenshots(frames, named, f"{tmp_path}/shots", "data")
    got = spark.read.parquet(f"{tmp_path}/shots").orderBy("frame_id").collect()
    # Video frames come every 1.5 s from 0; those at 10.5 and 21 s are the first due ones.
    assert [(r["stream_id"], r["frame_id"], r["path"], bytes(r["data"])) for r in got] == [
        (s, s * 1000 + n, f"d/p_{i}.png", bytes([s, n])) for s in (1, 2) for i, n in ((0, 21), (1, 42))
    ]


def test_recording_end_to_end(spark, frames, tmp_path):
    commands = spark.createDataFrame(
        [(1, 1, START + timedelta(seconds=5), "start"), (1, 2, START + timedelta(seconds=10), "stop")],
        "stream_id bigint, event_id bigint, ts timestamp_ntz, action string",
    )
    packets = recorder.recorded_packets(frames, commands, cell_seconds=7)
    recorder.save_recording(packets, "mp4", f"{tmp_path}/rec")
    got = spark.read.parquet(f"{tmp_path}/rec").orderBy("frame_id").collect()
    inside = [n for n in range(10, 20) if n % 3 != 2]
    assert [(r["frame_id"], r["session_id"], r["out_index"], r["pts"]) for r in got] == [
        (1000 + n, 1, n % 3, n * 45_000) for n in inside
    ]
    # An input without video in the session is left out.
    audio = frames.filter((F.col("media") != "video"))
    assert recorder.recorded_packets(audio, commands, cell_seconds=7).isEmpty()


def test_own_recorder(frames, tmp_path):
    from streamlens.sinks.recorders import record

    seen = []
    register_recorder("count", lambda df, path: seen.append((path, df.count())))
    record(recording.route_media(frames, cell_seconds=7), "count", "here")
    assert seen == [("here", 80)]


def test_mix_requests_end_to_end(spark):
    def stream(i, **changes):
        return {"id": i, "url": "rtmp://a", "width": 1, "height": 1, "x": 0, "y": 0, "z-index": 0, **changes}

    lists = [[stream("a"), stream("b")], [stream("a", x=3), stream("c"), stream("c", x=1)], [stream("c", x=1)]]
    df = spark.createDataFrame(
        [(7, n, json.dumps({"streams": x})) for n, x in enumerate(lists)], "task_id bigint, ver int, body string"
    )
    got = layout.layout_diff(mixer.layouts_of_requests(df)).collect()
    assert {tuple(r) for r in got} == {
        (7, 1, "a", "updated"), (7, 1, "b", "removed"), (7, 1, "c", "added"),
        (7, 2, "a", "removed"), (7, 2, "c", "unchanged"),
    }
