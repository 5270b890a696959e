import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import naive
from streamlens.functions.media import micros
from streamlens.operators import control, gaps
from streamlens.operators.cells import measure_cell_seconds, unplaced
from streamlens.streaming import operators as live

START = datetime(2024, 1, 1)
COMMAND = "stream_id bigint, event_id bigint, ts timestamp_ntz, action string"


def at(seconds):
    return START + timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def histories():
    rng, out = random.Random(3), {}
    for stream in range(80):
        t, rows = 0, []
        for n in range(rng.choice([1, 3, 30, 120])):
            t += rng.choice([0, 1, 1, 5, 40])
            rows.append((t, stream * 1000 + n, rng.choice(["start", "stop", "update"])))
        out[stream] = rows
    return out


@pytest.fixture(scope="module")
def commands(spark, histories):
    rows = [(s, e, at(t), a) for s, h in histories.items() for t, e, a in h]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, COMMAND).cache()


@pytest.mark.parametrize("cell_seconds", [1, 13, 10_000])
def test_outcomes_and_sessions(commands, histories, cell_seconds):
    got = control.command_outcome(commands, cell_seconds=cell_seconds).collect()
    want = {(s, e): o for s, h in histories.items() for e, o in naive.outcomes(h)}
    assert {(r["stream_id"], r["event_id"]): r["outcome"] for r in got} == want

    got = control.sessions_from_commands(commands, cell_seconds=cell_seconds).collect()
    want = {
        (s, e, at(a), None if b is None else at(b))
        for s, h in histories.items()
        for e, a, b in naive.command_sessions(h)
    }
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("cell_seconds", [1, 13, 10_000])
def test_packets_inside_sessions(spark, commands, histories, cell_seconds):
    rng = random.Random(5)
    packets = [(s, s * 10_000 + i, t) for s, h in histories.items()
               for i, t in enumerate(sorted(rng.randrange(0, h[-1][0] + 20) for _ in range(50)))]
    frames = spark.createDataFrame(
        [(s, f, at(t)) for s, f, t in packets], "stream_id bigint, frame_id bigint, ts timestamp_ntz"
    )
    sessions = control.sessions_from_commands(commands, cell_seconds=cell_seconds)
    got = control.record_sessions(frames, sessions, cell_seconds=cell_seconds).collect()
    spans = {s: naive.command_sessions(h) for s, h in histories.items()}
    want = {
        (s, e, f, at(t))
        for s, f, t in packets
        for e, a, b in spans[s]
        if a <= t and (b is None or t < b)
    }
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("cell_seconds", [1, 11, 10_000])
def test_sessions_of_two_methods_overlap(spark, cell_seconds):
    """Frames at borders of sessions, sessions without length, and a method nobody asked for."""
    rng, rows, frames = random.Random(6), [], []
    for stream in range(25):
        for method in ("mp4", "hls", "other"):
            t, last = rng.randrange(20), rng.randrange(8)
            for n in range(last):
                stop = t + rng.choice([0, 1, 7, 40])
                rows.append((stream, method, len(rows), t, None if n == last - 1 and rng.random() < 0.5 else stop))
                t = stop + rng.choice([0, 0, 3, 30])
        frames += [(stream, stream * 1000 + i, rng.randrange(200)) for i in range(60)]
    sessions = spark.createDataFrame(
        [(s, m, i, at(a), None if b is None else at(b)) for s, m, i, a, b in rows],
        "stream_id bigint, method string, session_id bigint, start_ts timestamp_ntz, stop_ts timestamp_ntz",
    )
    df = spark.createDataFrame(
        [(s, f, at(t)) for s, f, t in frames], "stream_id bigint, frame_id bigint, ts timestamp_ntz"
    )
    got = control.record_sessions(
        df, sessions, cell_seconds=cell_seconds, methods=("mp4", "hls")
    ).collect()
    want = sorted(
        (s, m, i, f, at(t))
        for s, f, t in frames
        for s2, m, i, a, b in rows
        if s == s2 and m != "other" and a <= t and (b is None or t < b)
    )
    assert sorted(tuple(r) for r in got) == want


@pytest.mark.parametrize("cell_seconds", [1, 10_000])
def test_running_tasks(commands, histories, cell_seconds):
    sessions = control.sessions_from_commands(commands, cell_seconds=100)
    got = control.active_task_profile(sessions, 10, cell_seconds).collect()
    spans = [x for h in histories.values() for x in naive.command_sessions(h)]
    changes = sorted({x for _, a, b in spans for x in (a, b) if x is not None})
    want = [
        (at(x), sum(a <= x and (b is None or x < b) for _, a, b in spans)) for x in changes
    ]
    assert sorted((r["ts"], r["active"]) for r in got) == want
    assert all(r["over_limit"] == (r["active"] > 10) for r in got)


@pytest.mark.parametrize("cell_seconds", [1, 13, 10_000])
def test_gaps(spark, cell_seconds):
    rng, streams = random.Random(11), {}
    for stream in range(60):
        t, times = rng.random(), []
        for _ in range(rng.choice([1, 5, 80])):
            times.append(round(t, 6))
            t += rng.choice([0.0, 0.5, 2.999999, 3.0, 3.000001, 30.0])
        streams[stream] = times
    df = spark.createDataFrame(
        [(s, i, at(t)) for s, ts in streams.items() for i, t in enumerate(ts)],
        "stream_id bigint, frame_id bigint, ts timestamp_ntz",
    )
    micros = {s: [(at(t) - START) // timedelta(microseconds=1) for t in ts] for s, ts in streams.items()}
    whole = {s: naive.sessions(ts, 3_000_000) for s, ts in micros.items()}
    got = gaps.gap_sessions(df, cell_seconds=cell_seconds).collect()
    want = {
        (s, no, START + timedelta(microseconds=a), START + timedelta(microseconds=b), n)
        for s, parts in whole.items()
        for no, a, b, n in parts
    }
    assert {tuple(r) for r in got} == want and len(got) == len(want)

    kept = gaps.until_timeout(df, cell_seconds=cell_seconds).collect()
    assert len(kept) == sum(parts[0][3] for parts in whole.values())
    ends = {s: START + timedelta(microseconds=parts[0][2]) for s, parts in whole.items()}
    assert all(r["ts"] <= ends[r["stream_id"]] for r in kept)


def test_gaps_of_ticks_need_a_time_base(spark):
    df = spark.createDataFrame([(1, n, n * 90_000) for n in range(5)], "stream_id bigint, frame_id bigint, dts bigint")
    assert gaps.gap_sessions(df, time="dts", tb=(1, 90_000)).collect()[0][1:] == (0, 0, 360_000, 5)
    assert gaps.gap_sessions(df, 0.5, "dts", tb=(1, 90_000)).count() == 5
    assert gaps.until_timeout(df, time="dts", tb=(1, 90_000)).count() == 5
    assert gaps.until_timeout(df, 0.5, "dts", tb=(1, 90_000)).count() == 1
    with pytest.raises(ValueError, match="time base"):
        gaps.gap_sessions(df, time="dts")


def test_rows_without_a_place_can_be_found(spark):
    rows = [(None, 1, at(0), "start"), (1, 1, None, "start"), (1, 2, at(1), "stop")]
    df = spark.createDataFrame(rows, "stream_id bigint, event_id bigint, ts timestamp_ntz, action string")
    assert unplaced(df).count() == 2
    for fn in (control.command_outcome, gaps.gap_sessions, gaps.until_timeout):
        assert fn(df).count() + unplaced(df).count() == df.count()


def test_cell_width_follows_the_fullest_cell(spark):
    rows = [(1, at(i)) for i in range(3600)] + [(2, at(0))]
    df = spark.createDataFrame(rows, "stream_id bigint, ts timestamp_ntz")
    assert measure_cell_seconds(df, target_rows=7200) == 7200
    assert measure_cell_seconds(df, target_rows=600) == 600
    assert measure_cell_seconds(df, target_rows=30) == 30
    assert measure_cell_seconds(df, None, target_rows=7202) == 7200


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_clock_knows_no_time_zone(spark, zone):
    """Also in the hour a clock change skips or repeats."""
    moments = [
        datetime(2024, 3, 10, 1, 59, 59, 999999), datetime(2024, 3, 10, 2, 30),
        datetime(2024, 11, 3, 1, 30), datetime(1969, 12, 31, 23, 59, 59, 999999),
        datetime(1970, 1, 1), datetime(2100, 6, 7, 8, 9, 10, 11),
    ]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(m,) for m in moments], "ts timestamp_ntz")
        got = [r[0] for r in df.select(micros("ts")).collect()]
        back = df.select(live._zone_free(F.timestamp_micros(micros("ts")))).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [(m - datetime(1970, 1, 1)) // timedelta(microseconds=1) for m in moments]
    assert [r[0] for r in back] == moments


def test_rows_without_a_place_are_set_aside_or_refused(spark, tmp_path):
    from streamlens.operators.cells import set_aside

    df = spark.createDataFrame([(1, 5), (None, 6), (2, None)], "stream_id bigint, ts bigint")
    with pytest.raises(ValueError, match="2 rows"):
        set_aside(df, None)
    assert [tuple(r) for r in set_aside(df, f"{tmp_path}/lost").collect()] == [(1, 5)]
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/lost").collect()} == {(None, 6), (2, None)}
    assert set_aside(df.filter("ts = 5"), None).count() == 1
