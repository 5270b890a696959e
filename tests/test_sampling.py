import random
from collections import defaultdict
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import naive
from streamlens.operators import sampling
from streamlens.operators.greedy import near_share_walk, walk_in_order
from streamlens.sinks.frames import name_frames
from streamlens.sources.frames import stream_durations, to_frames
from streamlens.sources.packets import PACKET_SCHEMA, read_packets

FRAME = "stream_id bigint, frame_id bigint, t double"


def random_streams(seed=7, count=120):
    """Streams with ties, jumps, long runs, sub-second spans and single rows."""
    rng, streams = random.Random(seed), {}
    for stream in range(count):
        scale = rng.choice([0.001, 0.04, 0.5, 3.0, 40.0])
        t, rows = rng.choice([0.0, 0.0, rng.random() * 5]), []
        for frame in range(rng.choice([1, 2, 15, 60, 200])):
            rows.append((t, stream * 1000 + (frame * 7919) % 1000))
            step = rng.choice([0.0, 1.0, 1.0, 1.0, rng.random(), 25.0])
            t = round(t + step * scale, 6)
        streams[stream] = rows
    return streams


@pytest.fixture(scope="module")
def streams():
    return random_streams()


@pytest.fixture(scope="module")
def frames(spark, streams):
    rows = [(s, f, float(t)) for s, rs in streams.items() for t, f in rs]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, FRAME).repartition(5).cache()


def by_stream(df, value="frame_id"):
    out = defaultdict(list)
    for r in df.orderBy("t", "frame_id").collect():
        out[r["stream_id"]].append(r[value])
    return dict(out)


def expected(streams, fn):
    kept = {s: fn(rows) for s, rows in streams.items()}
    return {s: k for s, k in kept.items() if k}


@pytest.mark.parametrize("interval", [1, 2, 5, 60])
def test_interval(frames, streams, interval):
    want = expected(streams, lambda r: naive.interval(r, interval))
    assert by_stream(sampling.sample_interval(frames, interval)) == want


def test_interval_state_is_in_whole_seconds(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (1, 2, 1.9), (1, 3, 2.1), (1, 4, 3.0)], FRAME)
    # 1.9 counts as 1, so 2.1 is a second later.
    assert by_stream(sampling.sample_interval(df, 1)) == {1: [2, 3, 4]}


def test_interval_over_small_arrow_batches(spark, frames, streams):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        want = expected(streams, lambda r: naive.interval(r, 2))
        assert by_stream(sampling.sample_interval(frames, 2)) == want
        durations = {s: max(t for t, _ in r) for s, r in streams.items()}
        want = expected(
            {s: [(t, f, s) for t, f in r] for s, r in streams.items()},
            lambda r: naive.percentage([x[:2] for x in r], 5, durations[r[0][2]]),
        )
        got = sampling.sample_percentage(frames, 5, stream_durations(frames))
        assert by_stream(got) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize(
    ("pct", "bins"),
    [(1, 10**6), (10, 10**6), (33, 10**6), (100, 10**6), (1, 200), (3, 777), (10, 200), (33, 1000), (100, 200)],
)
def test_percentage(frames, streams, pct, bins):
    durations = {s: max(t for t, _ in r) for s, r in streams.items()}
    want = {s: naive.percentage(r, pct, durations[s]) for s, r in streams.items()}
    got = sampling.sample_percentage(frames, pct, stream_durations(frames), bins=bins)
    assert by_stream(got) == {s: k for s, k in want.items() if k}


@pytest.mark.parametrize(("pct", "bins"), [(1, 200), (1, 50_000), (7, 1000), (10, 10**6)])
def test_percentage_of_a_dense_stream(spark, pct, bins):
    """Frames far closer than bins, so that the chains of kept rows stay apart."""
    rng = random.Random(pct)
    rows = [(rng.random() * 900 + 100 * (rng.random() < 0.01), i) for i in range(20_000)]
    rows += [(t, i + 50_000) for t, i in rows[::3]]
    df = spark.createDataFrame([(1, i, t) for t, i in rows], FRAME).repartition(6)
    got = sampling.sample_percentage(df, pct, stream_durations(df), bins=bins)
    assert by_stream(got) == {1: naive.percentage(rows, pct, max(t for t, _ in rows))}


def test_bins_of_a_dense_stream_that_rows_are_looked_up_in(spark):
    """With 10 rows to keep, at most about 50 of the bins."""
    summary = pa.RecordBatch.from_pydict(
        {"s": [1] * 9_900, "b": range(100, 10_000),
         "low": [b / 100 + 0.001 for b in range(100, 10_000)],
         "high": [b / 100 + 0.009 for b in range(100, 10_000)]}
    )
    parts = [summary.slice(i, 37) for i in range(0, 9_900, 37)]
    whole = list(near_share_walk(10)(iter([summary])))[0]
    assert 10 <= whole.num_rows <= 65
    split = pa.Table.from_batches(list(near_share_walk(10)(iter(parts))))
    assert split.column("b").to_pylist() == whole.column("b").to_pylist()


def test_percentage_edges(spark):
    rows = [
        (1, 1, 0.0), (1, 2, 0.3), (1, 3, 0.6),  # shorter than a second
        (2, 4, 1.0), (2, 5, 2.0),  # unknown duration
        (3, 6, 1.0), (3, 7, 9.0),  # reported longer than it is
        (4, 8, 5.0),  # no duration given
    ]
    df = spark.createDataFrame(rows, FRAME)
    durations = spark.createDataFrame([(1, 0.9), (2, -1.0), (3, 100.0)], "stream_id bigint, duration double")
    for bins in (10**6, 200):
        got = sampling.sample_percentage(df, 5, durations, bins=bins)
        assert by_stream(got) == {1: [2], 3: [7]}
        assert {r["pct"] for r in got.collect()} == {float("inf"), 9.0}


@pytest.mark.parametrize("drain", [0, 3])
def test_first_and_at_time(frames, streams, drain):
    want = expected(streams, lambda r: naive.first_at(r, float("-inf"), 1 + drain))
    assert by_stream(sampling.sample_first(frames, drain)) == want
    want = expected(streams, lambda r: naive.first_at(r, 4, 1 + drain))
    assert by_stream(sampling.sample_at_time(frames, 4, drain)) == want


@pytest.mark.parametrize("cell_seconds", [1, 7, 100_000])
def test_at_times(spark, frames, streams, cell_seconds):
    moments = (0, 1, 4, 30, 900)
    wanted = spark.createDataFrame(
        [(s, a) for s in list(streams) + [999] for a in moments], "stream_id bigint, at int"
    )
    got = {
        (r["stream_id"], r["at"]): r["frame_id"]
        for r in sampling.sample_at_times(frames, wanted, cell_seconds).collect()
    }
    want = {(s, a): naive.first_at(r, a) for s, r in streams.items() for a in moments}
    assert got == {k: v[0] for k, v in want.items() if v}


@pytest.mark.parametrize("cell_seconds", [1, 100_000])
def test_names_count_from_zero(frames, streams, cell_seconds):
    named = name_frames(frames, "out", "shot", cell_seconds=cell_seconds)
    got = defaultdict(list)
    for r in named.orderBy("frame_no").collect():
        assert r["path"] == f"out/shot_{r['frame_no']}.png"
        got[r["stream_id"]].append(r["frame_id"])
    assert got == {s: [f for _, f in sorted(r)] for s, r in streams.items()}


def test_methods_by_name(spark, frames):
    same = sampling.sample(frames, "interval", interval=5)
    assert by_stream(same) == by_stream(sampling.sample_interval(frames, 5))
    with pytest.raises(ValueError, match="Invalid screenshot method."):
        sampling.sample(frames, "bogus")
    sampling.register_sampler("late", lambda df, after: df.filter(F.col("t") > after))
    assert sampling.sample(frames, "late", after=10**9).isEmpty()


@pytest.mark.parametrize(
    ("fn", "arg", "text"),
    [
        (lambda df, x: sampling.sample_interval(df, x), 0, "Interval must be positive."),
        (lambda df, x: sampling.sample_percentage(df, x, df), 0, "Percentage must be between"),
        (lambda df, x: sampling.sample_percentage(df, x, df), 101, "Percentage must be between"),
        (lambda df, x: sampling.sample_at_time(df, x), -1, "time_second must be non-negative."),
    ],
)
def test_ranges(frames, fn, arg, text):
    with pytest.raises(ValueError, match=text):
        fn(frames, arg)


@pytest.mark.parametrize("cell_seconds", [1, 10_000])
def test_frames_from_ticks(spark, cell_seconds):
    df = spark.createDataFrame(
        [(1, 1, 900_000), (1, 2, 990_000), (1, 3, 90_000_000), (2, 9, 5)],
        "user bigint, event bigint, ticks bigint",
    )
    got = to_frames(df, "user", "event", "ticks", (1, 90_000), cell_seconds)
    rows = {r["frame_id"]: (r["stream_id"], r["pts"], r["t"]) for r in got.collect()}
    assert rows[1] == (1, 900_000, 900_000 * (1 / 90_000))
    assert rows[2] == (1, 990_000, 990_000 * (1 / 90_000))
    assert rows[9] == (2, 5, 5 * (1 / 90_000))


def test_frames_from_raw_packets(spark, tmp_path):
    """Packets are written and read by their own schema; their ticks are taken as they are."""
    rows = [(1, n, 0, "video", n % 2 == 0, 900_000 + 3_000 * n, 900_000 + 3_000 * n, 4, 2, b"x") for n in range(9)]
    spark.createDataFrame(rows, PACKET_SCHEMA).write.parquet(str(tmp_path / "packets"))
    packets = read_packets(spark, str(tmp_path / "packets"))
    for keep in (False, True):
        frames = to_frames(packets, time="pts", tb=(1, 90_000), keep_cells=keep)
        assert frames.columns.count("pts") == 1
        frames.write.parquet(str(tmp_path / f"frames{keep}"))
        got = spark.read.parquet(str(tmp_path / f"frames{keep}"))
        assert got.agg(F.min("t"), F.max("pts")).first()[:] == (900_000 * (1 / 90_000), 924_000)
    assert sampling.sample_at_time(frames, 10).first()["frame_id"] == 0


@pytest.mark.parametrize("salts", [1, 16])
def test_origin_is_the_first_row_of_any_media(spark, salts, monkeypatch):
    monkeypatch.setattr("streamlens.sources.frames.ORIGIN_SALTS", salts)
    rows = [(s, n, datetime(2024, 1, 1 + s, 0, 0, n)) for s in range(3) for n in range(5, 25)]
    df = spark.createDataFrame(rows, "stream_id bigint, frame_id bigint, ts timestamp_ntz")
    for keep in (False, True):
        got = to_frames(df, keep_cells=keep).select("frame_id", "pts").distinct().collect()
        assert sorted(tuple(r) for r in got) == [(n, (n - 5) * 1_000_000) for n in range(5, 25)]


def test_callback_per_stream(spark, frames, streams):
    """A user's function of each stream's frames, here the gaps between them."""
    schema = frames.select("stream_id", F.col("t").alias("gap")).schema

    def gaps(batches):
        stream, last = None, None
        for batch in batches:
            out = []
            for s, t in zip(batch["stream_id"].to_pylist(), batch["t"].to_pylist()):
                if s == stream:
                    out.append((s, t - last))
                stream, last = s, t
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.float64())],
                ["stream_id", "gap"],
            )

    got = defaultdict(list)
    for r in walk_in_order(frames, "stream_id", ["t", "frame_id"], gaps, schema).collect():
        got[r["stream_id"]].append(r["gap"])
    want = {s: [b - a for (a, _), (b, _) in zip(sorted(r), sorted(r)[1:])] for s, r in streams.items()}
    assert got == {s: g for s, g in want.items() if g}
