"""Live operators over several micro-batches give the batch operators' rows."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import naive
from streamlens.operators import control, gaps, layout, recording, sampling
from streamlens.plans import recorder
from streamlens.plans.registry import all_queries
from streamlens.sinks.commits import commit_batches, read_committed
from streamlens.sinks.frames import push_stream
from streamlens.sources.packets import read_packet_stream
from streamlens.streaming import operators as live

START = datetime(2024, 1, 1)
EVENT = (
    "stream_id bigint, frame_id bigint, event_id bigint, ts timestamp_ntz, t double, action string, media string,"
    " stream_index int, is_key boolean, pts bigint, dts bigint"
)
LATE = 25


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(12), []
    clock = 0.0
    for n in range(900):
        clock += rng.choice([0.0, 0.1, 0.7, 4.0])
        at = round(clock, 6)
        # One stream sends a third of everything.
        stream = 0 if rng.random() < 1 / 3 else rng.randrange(1, 12)
        action = rng.choice(["start", "stop", "update"])
        media = rng.choice(["video", "audio", "audio", "data"] if stream != 5 else ["audio", "data"])
        out.append((stream, n, n, START + timedelta(seconds=at), at, action, media, rng.randrange(2), rng.random() < 0.4, n * 7, n * 7 - 1))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, EVENT).cache()


def aged_files(spark, pieces, schema, place):
    """A file for each piece, whose age gives their order."""
    for part, piece in enumerate(pieces):
        spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").parquet(str(place))
        for file in place.glob("part-*.parquet"):
            if file.stat().st_mtime > 1_700_000_100:
                os.utime(file, (1_700_000_000 + part, 1_700_000_000 + part))
    return str(place)


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    """The rows in six files, in order."""
    size = len(rows) // 6
    pieces = [rows[part * size : (part + 1) * size] for part in range(6)]
    return aged_files(spark, pieces, EVENT, tmp_path_factory.mktemp("live"))


@pytest.fixture(scope="module")
def late_folder(spark, rows, tmp_path_factory):
    """The rows in five files, up to 25 seconds late, and a row without a stream that ends them."""
    rng = random.Random(13)
    shuffled = sorted(rows, key=lambda r: r[4] + rng.uniform(0, LATE - 0.1))
    size = len(rows) // 5
    pieces = [shuffled[part * size : (part + 1) * size] for part in range(5)]
    assert all(min(r[4] for r in b) < max(r[4] for r in a) for a, b in zip(pieces, pieces[1:]))
    end = [(None, None, None, START + timedelta(days=9), 9 * 86_400.0, *[None] * 6)]
    return aged_files(spark, [*pieces, end], EVENT, tmp_path_factory.mktemp("late"))


def read(spark, folder):
    return read_packet_stream(
        spark, folder, spark.read.parquet(folder).schema, maxFilesPerTrigger="1"
    )


def drain(spark, sdf, tmp_path, progress=None):
    with live.live_settings(spark, 3):
        query = push_stream(sdf, str(tmp_path / "out"), str(tmp_path / "state"), drain=True)
        query.awaitTermination()
    if progress is not None:
        progress += query.recentProgress
    return spark.read.schema(sdf.schema).parquet(str(tmp_path / "out"))


def same(got, want):
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))


def test_late_rows_of_a_sampler_by_interval(spark, table, late_folder, tmp_path):
    progress = []
    sdf = live.stream_sample_interval(read(spark, late_folder), 7, f"{LATE} seconds", bucket_seconds=3)
    same(drain(spark, sdf, tmp_path, progress), sampling.sample_interval(table, 7))
    assert len([p for p in progress if p["numInputRows"]]) == 6


@pytest.mark.parametrize("kept", [0, 4])
def test_late_rows_of_a_sampler_of_first_frames(spark, table, late_folder, tmp_path, kept):
    sdf = live.stream_sample_first(read(spark, late_folder), kept, f"{LATE} seconds")
    same(drain(spark, sdf, tmp_path), sampling.sample_first(table, kept))


def test_late_commands(spark, table, late_folder, tmp_path):
    sdf = live.stream_commands(read(spark, late_folder), f"{LATE} seconds", bucket_seconds=100)
    same(drain(spark, sdf, tmp_path), control.command_outcome(table))


def test_ended_tasks_are_closed_and_forgotten(spark, rows, late_folder, tmp_path):
    """Between two commands far apart, and when no more come; no state is left."""
    progress = []
    sdf = live.stream_commands(read(spark, late_folder), f"{LATE} seconds", bucket_seconds=3, idle_seconds=30)
    got = drain(spark, sdf, tmp_path, progress).select("stream_id", "event_id", "action", "outcome")
    expected = []
    for stream in {r[0] for r in rows}:
        own, life, runs = sorted((r[4], r[2], r[5]) for r in rows if r[0] == stream), [], False
        lives = []
        for k, row in enumerate(own):
            if k and row[0] - own[k - 1][0] > 30:
                lives.append(life)
                life = []
            life.append(row)
        for life in [*lives, life]:
            expected += [(stream, event, dict((e, a) for _, e, a in life)[event], what) for event, what in naive.outcomes(life)]
            runs = [a for _, _, a in life if a != "update"][-1:] == ["start"]
            expected += [(stream, None, "end", "stopped")] * runs
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))
    assert sum(e[1] is None for e in expected) > 12
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) > 0
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 0


def test_waiting_entries_are_bounded_by_groups(spark, tmp_path):
    """However many streams a batch has, its rows wait in an entry for each group and bucket."""
    rows = [(s, s, START, a) for s in range(3000) for a in ("start", "update")]
    path = aged_files(spark, [rows], "stream_id bigint, event_id bigint, ts timestamp_ntz, action string", tmp_path / "many")
    progress = []
    sdf = live.stream_commands(read(spark, path), f"{LATE} seconds", bucket_seconds=100)
    drain(spark, sdf, tmp_path, progress)
    held = max(p["stateOperators"][0]["numRowsTotal"] for p in progress)
    # an entry, its timer in two orders and the number of entries
    assert 0 < held <= 4 * live.GROUPS < 3000


def test_large_numbers_beside_nulls(spark, tmp_path):
    """Numbers that no double holds stay as they are where others of the same streams are null."""
    big = 2**53 + 1
    kind = "stream_id bigint, event_id bigint, ts timestamp_ntz, action string"
    first = [(1, big, START, "start"), (1, None, START, "update"), (2, big + 2, START, "stop")]
    second = [(1, big + 4, START + timedelta(seconds=3), "stop")]
    end = [(None, None, START + timedelta(days=9), None)]
    path = aged_files(spark, [first, second, end], kind, tmp_path / "big")
    sdf = live.stream_commands(read(spark, path), f"{LATE} seconds", bucket_seconds=7)
    got = {tuple(r) for r in drain(spark, sdf, tmp_path).collect()}
    assert got == {
        (1, big, "start", "started"), (1, None, "update", "updated"),
        (2, big + 2, "stop", "not_running"), (1, big + 4, "stop", "stopped"),
    }


def test_running_tasks_of_many_groups(spark, tmp_path):
    kind = "stream_id string, event_id bigint, ts timestamp_ntz, action string"
    rows = [(f"s{n}", n, START, "start" if n % 3 else "stop") for n in range(500)]
    end = [(None, None, START + timedelta(days=9), None)]
    path = aged_files(spark, [rows, end], kind, tmp_path / "tasks")
    drain(spark, live.stream_commands(read(spark, path), f"{LATE} seconds"), tmp_path)
    states = live.task_states(spark, str(tmp_path / "state"))
    assert states.columns == ["stream_id", "active"]
    assert {tuple(r) for r in states.collect()} == {(f"s{n}", n % 3 > 0) for n in range(500)}


def test_live_playlist(spark, table, late_folder, tmp_path):
    live_rows = read(spark, late_folder)
    sdf = live.stream_manifest(live_rows, 20, "out", f"{LATE} seconds", bucket_seconds=7, idle_seconds=9000)
    same(drain(spark, sdf, tmp_path), recording.segment_manifest(table, 20))


def test_live_recording_of_a_repeated_batch(spark, table, late_folder, tmp_path):
    """The last batch runs again after its commit is lost; nothing is written twice."""
    folder = read(spark, late_folder)
    sdf = live.stream_recording(folder, folder, watermark=f"{LATE} seconds", bucket_seconds=3)
    out, state, numbers = str(tmp_path / "out"), tmp_path / "state", []
    write = commit_batches(spark, out, sdf.schema)

    def sink(batch, number):
        numbers.append(number)
        write(batch, number)

    with live.live_settings(spark, 3):
        push_stream(sdf, sink, str(state), drain=True).awaitTermination()
        want = recorder.recorded_packets(table, table.filter("action <> 'update'"), per_recording=True)
        same(read_committed(spark, out, sdf.schema), want)
        last = max(numbers)
        for name in (str(last), f".{last}.crc"):
            if (state / "commits" / name).exists():
                (state / "commits" / name).unlink()
        push_stream(sdf, sink, str(state), drain=True).awaitTermination()
    assert numbers.count(last) == 2 and len(set(numbers)) >= 6
    same(read_committed(spark, out, sdf.schema), want)


def test_half_written_batches_are_not_seen(spark, tmp_path):
    rows = spark.range(5)
    path = str(tmp_path / "out")
    write = commit_batches(spark, path, rows.schema)
    write(rows, 3)
    rows.write.parquet(f"{path}/data/_batch=4")
    assert read_committed(spark, path, rows.schema).count() == 5
    write(spark.range(7), 4)
    write(spark.range(9), 3)
    assert read_committed(spark, path, rows.schema).count() == 12


@pytest.mark.parametrize("name", ["stream_gap_sessions"])
def test_live_queries_read_a_folder_of_files(spark, tmp_path, name):
    """A table that is a folder gives the rows of the one that is a file."""
    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(6).write.parquet(str(tmp_path / "events.parquet"))
    same(all_queries()[name](spark, str(tmp_path)), all_queries()[name](spark, sf))


def late_end(spark, sdf, tmp_path):
    """Live rows and then one far later, so that everything before it is over."""
    end = spark.createDataFrame([(None, START + timedelta(days=9))], "stream_id bigint, ts timestamp_ntz")
    end.write.parquet(str(tmp_path / "end"))
    return sdf.select("stream_id", "ts").unionByName(
        spark.readStream.schema(end.schema).parquet(str(tmp_path / "end"))
    )


def test_gap_sessions(spark, table, folder, tmp_path):
    # A whole-table trigger: with the end in the first batch, later batches would all be late.
    events = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    live.merge_sessions_before_shuffle(spark)
    got = drain(spark, live.stream_gap_sessions(late_end(spark, events, tmp_path)), tmp_path)
    same(got, gaps.gap_sessions(table))


def test_gap_sessions_over_batches(spark, table, folder, tmp_path):
    """Without an end, the sessions that are over by the watermark come out, unchanged."""
    got = drain(spark, live.stream_gap_sessions(read(spark, folder), watermark="1 second"), tmp_path)
    whole = {tuple(r) for r in gaps.gap_sessions(table).select(got.columns).collect()}
    found = {tuple(r) for r in got.collect()}
    assert found and found <= whole
    last = max(r[2] for r in whole)
    over = {r for r in whole if r[2] + timedelta(seconds=3) < last - timedelta(seconds=1)}
    assert over <= found


def test_segments(spark, table, folder, tmp_path):
    events = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    got = drain(spark, live.stream_segments(late_end(spark, events, tmp_path)), tmp_path)
    want = table.groupBy("stream_id", F.window(F.col("ts").cast("timestamp"), "5 seconds").alias("w")).count()
    same(got, want.select(
        "stream_id", F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"), F.col("count").alias("n"),
    ))


@pytest.mark.parametrize("idle", [None, 40])
def test_late_layouts(spark, tmp_path, idle):
    rng = random.Random(4)
    kind = (
        "task_id bigint, ver int, streams array<struct<id:string,url:string,width:int,"
        "height:int,x:int,y:int,z:int>>"
    )
    rows = []
    for ver in range(24):
        for task in range(5):
            ids = rng.sample("abcde", rng.randrange(0 if ver else 1, 5))
            streams = [(i, f"rtmp://{rng.randrange(3)}", rng.randrange(2), 1, 0, 0, 0) for i in ids]
            if streams:
                rows.append((task, ver, streams))
    shuffled = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 2.9))
    pieces = [shuffled[len(rows) * k // 5 : len(rows) * (k + 1) // 5] for k in range(5)]
    path = aged_files(spark, [*pieces, [(None, 10_000, None)]], kind, tmp_path / "updates")
    whole = spark.createDataFrame(rows, kind)
    sdf = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = drain(spark, live.stream_layout(sdf, "3 seconds", bucket_seconds=2, idle_seconds=idle), tmp_path)
    last = {task: (ver, streams) for task, ver, streams in rows}
    shown = [(task, None, s[0], "removed") for task, (_, streams) in last.items() for s in streams]
    want = layout.layout_diff(whole.selectExpr("task_id", "ver", "inline(streams)")).select(got.columns)
    if idle:
        want = want.unionByName(spark.createDataFrame(shown, want.schema))
    same(got, want)


def test_layouts_beside_nulls(spark, tmp_path):
    """An entry without a geometry changes nothing for others of its batch, and is unchanged itself."""
    kind = (
        "task_id bigint, ver int, streams array<struct<id:string,url:string,width:int,"
        "height:int,x:int,y:int,z:int>>"
    )
    entry = ("a", "rtmp://0", 101, 51, 4, 0, 1)
    bare = ("b", "rtmp://0", None, None, None, 0, None)
    rows = [(task, ver, [entry, bare] if task < 20 else [entry]) for ver in range(6) for task in range(40)]
    pieces = [rows[:80], rows[80:160], rows[160:], [(None, 10_000, None)]]
    path = aged_files(spark, pieces, kind, tmp_path / "updates")
    sdf = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)
    got = drain(spark, live.stream_layout(sdf, "1 second", bucket_seconds=1), tmp_path)
    assert got.count() == 5 * 60 and got.filter("change <> 'unchanged'").isEmpty()


def test_push_to_a_function(spark, folder, tmp_path):
    seen = []
    query = push_stream(
        read(spark, folder), lambda batch, n: seen.append(batch.count()), str(tmp_path / "s"), drain=True
    )
    query.awaitTermination()
    assert seen == [150] * 6
