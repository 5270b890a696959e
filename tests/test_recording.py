import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import naive
from streamlens.functions import media
from streamlens.operators import recording
from streamlens.sinks import recorders
from streamlens.sinks.frames import rows_of_stream
from streamlens.sources.packets import PACKET_SCHEMA, media_files, probe_streams, read_packets

PACKET = "stream_id bigint, frame_id bigint, stream_index int, media string, t double"


@pytest.fixture(scope="module")
def packets():
    rng, out = random.Random(9), {}
    for stream in range(60):
        t, rows = rng.choice([0.0, 3.3]), []
        for n in range(rng.choice([1, 10, 150])):
            rows.append((t, stream * 1000 + (n * 37) % 1000, rng.random() < 0.3))
            t = round(t + rng.choice([0.0, 0.4, 2.5, 5.0, 31.0]), 6)
        out[stream] = rows
    return out


@pytest.fixture(scope="module")
def frames(spark, packets):
    rows = [(s, f, t, k) for s, ps in packets.items() for t, f, k in ps]
    random.Random(4).shuffle(rows)
    return spark.createDataFrame(
        rows, "stream_id bigint, frame_id bigint, t double, is_key boolean"
    ).cache()


def test_segments(frames, packets):
    want = {(s, f): n for s, ps in packets.items() for f, n in naive.segments(ps, 5)}
    got = recording.assign_segments(frames).collect()
    assert {(r["stream_id"], r["frame_id"]): r["segment_no"] for r in got} == want
    assert len(got) == len(want)


def test_manifest(frames, packets):
    got = recording.segment_manifest(frames, base="rec.m3u8").collect()
    times = {(s, f): t for s, ps in packets.items() for t, f, _ in ps}
    spans = defaultdict(list)
    for s, ps in packets.items():
        for f, n in naive.segments(ps, 5):
            spans[s, n].append(times[s, f])
    assert len(got) == len(spans)
    for r in got:
        ts = spans[r["stream_id"], r["segment_no"]]
        assert (r["start_t"], r["end_t"], r["n"]) == (min(ts), max(ts), len(ts))
        assert r["duration"] == max(ts) - min(ts)
        assert r["file_name"] == f"rec_{r['segment_no']:03d}.ts"


@pytest.mark.parametrize("cell_seconds", [1, 50])
def test_interleave(frames, packets, cell_seconds):
    df = frames.select(
        "stream_id", "frame_id", (F.col("frame_id") % 2).cast("int").alias("out_index"),
        F.round(F.col("t") * 1_000_000).cast("bigint").alias("dts"),
    )
    got = defaultdict(list)
    for r in recording.interleave(df, cell_seconds=cell_seconds).orderBy("seq").collect():
        assert r["seq"] == len([x for x in got[r["stream_id"]]])
        got[r["stream_id"]].append(r["frame_id"])
    for s, ps in packets.items():
        assert got[s] == [f for _, _, f in sorted((t, f % 2, f) for t, f, _ in ps)]


def test_routing_takes_first_streams_once(spark):
    rows = [
        (1, 1, 0, "audio", 0.0), (1, 2, 1, "video", 0.1), (1, 3, 2, "video", 0.2),  # audio first
        (1, 4, 0, "audio", 50.0), (1, 5, 3, "audio", 50.1), (1, 6, 1, "video", 90.0),
        (2, 7, 0, "video", 0.0), (2, 8, 1, "data", 0.1),  # no audio
        (3, 9, 0, "audio", 0.0),  # no video
    ]
    df = spark.createDataFrame(rows, PACKET)
    for cell_seconds in (1, 1000):
        got = recording.route_media(df, cell_seconds=cell_seconds).collect()
        assert sorted((r["frame_id"], r["out_index"]) for r in got) == [
            (1, 1), (2, 0), (4, 1), (6, 0), (7, 0)
        ]
    got = {tuple(r) for r in probe_streams(df).collect()}
    assert got == {(1, 1, 0), (2, 0, None)}


def test_rescale_is_exact(spark):
    rng = random.Random(8)
    values = [None, 0, 1, -1, 50, -50, 150, -150, 2**62, -(2**62)]
    values += [rng.randrange(-(2**60), 2**60) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "x bigint")
    for src, dst in [((1, 100), (1, 1)), ((1, 1_000_000), (1, 90_000)), ((1001, 30_000), (1, 90_000))]:
        rows = df.select("x", media.rescale_ts("x", src, dst).alias("y")).collect()
        for x, y in rows:
            if x is None:
                assert y is None
                continue
            exact = abs(x) * Fraction(*src) / Fraction(*dst)
            nearest = (exact * 2 + 1) // 2
            want = int(nearest) * (1 if x >= 0 else -1)
            assert y == (want if abs(want) < 2**63 - 1 else None)


def test_rescale_by_columns(spark):
    rng = random.Random(5)
    terms = [1, 25, 1001, 30_000, 2**31 - 1]
    rows = [(rng.randrange(-(2**62), 2**62), *rng.choices(terms, k=4)) for _ in range(200)]
    rows += [(None, 1, 1, 1, 1), (7, 1, 2, 1, 1), (-7, 1, 2, 1, 1)]
    df = spark.createDataFrame(rows, "x bigint, a int, b bigint, c int, d int")
    src, dst = (F.col("a"), F.col("b")), (F.col("c"), F.col("d"))
    for x, a, b, c, d, y in df.select("*", media.rescale_ts("x", src, dst)).collect():
        if x is None:
            assert y is None
            continue
        want = int((abs(x) * Fraction(a, b) / Fraction(c, d) * 2 + 1) // 2) * (1 if x >= 0 else -1)
        assert y == (want if abs(want) < 2**63 - 1 else None)


@pytest.mark.parametrize("limit", [1, 1001, 60_000, 2**31 - 1])
def test_best_ratio(spark, limit):
    """No fraction within the limit is nearer; below 1 only its denominator, above only its numerator binds."""
    rng = random.Random(limit)
    size = lambda: 10 ** rng.randrange(1, 18)
    rows = [(rng.randrange(size()), rng.randrange(1, size() + 1)) for _ in range(600)]
    rows += [(0, 5), (10**17, 1), (1, 10**17), (30_000 * 999, 1001 * 999), (5, 0), (None, 1), (-1, 2)]
    df = spark.createDataFrame(rows, "n bigint, d bigint")
    for n, d, got in df.select("n", "d", media.best_ratio(F.col("n"), F.col("d"), limit)).collect():
        if n is None or n < 0 or d == 0:
            assert got is None
            continue
        exact, near = Fraction(n, d), Fraction(got["num"], got["den"])
        assert (near.numerator, near.denominator) == tuple(got) and max(tuple(got)) <= limit
        if exact <= 1:
            assert abs(near - exact) == abs(exact.limit_denominator(limit) - exact)
        elif exact > limit:
            assert near == limit
        else:
            other = 1 / (1 / exact).limit_denominator(limit) if 1 / exact >= Fraction(1, limit) else near
            assert abs(near - exact) <= abs(other - exact)


@pytest.mark.parametrize("width", [1, 10**9])
def test_output_time_bases(spark, width):
    """Frame rates of ticks rounded to microseconds, with frames out of order; audio keeps its base."""
    rates = {1: Fraction(25), 2: Fraction(30), 3: Fraction(30_000, 1001), 4: Fraction(1, 7)}
    rows = [
        (s, s, i * 2 + s, 0, round(i / rate * 10**6) + 5_000)
        for s, rate in rates.items() for i in range(3000)
    ]
    rows += [(s, s, -i, 1, i * 1024) for s in rates for i in range(9)]
    rows += [(5, 5, 1, 0, 100), (6, 6, 1, 0, 100), (6, 6, 2, 0, 100), (7, 7, 1, 1, 0), (8, 8, 1, 0, None)]
    random.Random(2).shuffle(rows)
    schema = "stream_id int, session_id int, frame_id int, out_index int, pts bigint"
    df = spark.createDataFrame(rows, schema).withColumn("_cell", F.expr(f"coalesce(pts, 0) div {width * 10**6}"))
    got = recording.with_time_base(df, (1, 10**6), (1, 44_100))
    assert got.count() == len(rows)
    bases = {(r[0], r[1]): tuple(r)[2:] for r in got.select("stream_id", "out_index", "tb_num", "tb_den").distinct().collect()}
    want = {(s, 0): (r.denominator, r.numerator) for s, r in rates.items()}
    want |= {(s, 1): (1, 44_100) for s in (*rates, 7)} | {(s, 0): (1, 10**6) for s in (5, 6, 8)}
    assert bases == want


def test_audio_time_base(spark):
    df = spark.createDataFrame([(0, 90, 90), (1, 48, 48)], "out_index int, pts bigint, dts bigint")
    args = ((1, 90_000), (1, 48_000), (1, 1000), (1, 48_000))
    right = recording.rescale_packets(df, *args).collect()
    assert [tuple(r) for r in right] == [(0, 1, 1), (1, 48, 48)]
    same = recording.rescale_packets(df, *args, audio_uses_video_tb=True).collect()
    assert [tuple(r) for r in same] == [(0, 1, 1), (1, 26, 26)]


def test_frame_rate(spark):
    df = spark.createDataFrame(
        [(1, 0.0), (1, 0.5), (1, 1.0), (2, 4.0), (3, 1.0), (3, 1.0)], "stream_id bigint, t double"
    )
    fps = recording.estimate_frame_rate(df)
    assert {tuple(r) for r in fps.collect()} == {(1, 2.0), (2, None), (3, None)}
    ticks = {r["stream_id"]: r["tick_seconds"] for r in recording.output_time_base(fps).collect()}
    assert ticks == {1: 0.5, 2: None, 3: None}


def test_names(spark):
    df = spark.createDataFrame([("a/b/c.mp4",), ("plain",), ("x/",), ("a.b.m3u8",), (".mp4",)], "u string")
    rows = df.select(
        media.url_basename("u"), media.has_recording_suffix("u"), media.segment_file_name("u", F.lit(7))
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("c.mp4", True, "a/b/c_007.ts"),
        ("plain", False, "plain_007.ts"),
        ("", False, "x/_007.ts"),
        ("a.b.m3u8", True, "a.b_007.ts"),
        (".mp4", True, "_007.ts"),
    ]
    wide = df.limit(1).select(media.segment_file_name(F.lit("r.mp4"), F.lit(1234))).first()[0]
    assert wide == "r_1234.ts"
    live = spark.range(1).select(media.is_live(F.lit("rtmp://x")), media.is_live(F.lit("RTMP://x"))).first()
    assert tuple(live) == (True, False)


def test_task_keys_stay_apart(spark):
    df = spark.createDataFrame([("a_b", "c"), ("a", "b_c")], "u string, m string")
    assert df.select(media.task_key("u", "m").alias("k")).distinct().count() == 2


def test_progress(spark):
    df = spark.createDataFrame([(5.0, 10.9), (1.0, 0.5)], "t double, d double")
    assert [r[0] for r in df.select(media.progress_percent("t", "d")).collect()] == [50.0, None]


def test_single_recordings_are_in_order(spark, frames, packets, tmp_path):
    df = frames.select(
        "stream_id", "frame_id", "t", F.lit(0).alias("out_index"), "is_key",
        F.round(F.col("t") * 1_000_000).cast("bigint").alias("dts"),
    )
    recorders.record(df, "mp4", f"{tmp_path}/single")
    for stream in (0, 7, 33):
        parts = sorted((tmp_path / "single" / f"stream_id={stream}").glob("*.parquet"))
        dts = [r["dts"] for p in parts for r in spark.read.parquet(str(p)).collect()]
        assert dts == sorted(dts) and len(dts) == len(packets[stream])

    recorders.record(df, "hls", f"{tmp_path}/cut")
    written = spark.read.parquet(f"{tmp_path}/cut/segments")
    want = {(s, f, n) for s, ps in packets.items() for f, n in naive.segments(ps, 5)}
    got = written.select("stream_id", "frame_id", "segment_no").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    manifest = spark.read.parquet(f"{tmp_path}/cut/manifest")
    assert manifest.count() == len({(s, n) for s, _, n in want})
    with pytest.raises(ValueError, match="Invalid recording method."):
        recorders.record(df, "avi", f"{tmp_path}/none")


@pytest.mark.parametrize("method, part", [("mp4", ""), ("hls", "/segments")])
def test_many_inputs_share_folders(spark, tmp_path, method, part):
    """Folders are as many as asked for, not as many as inputs; an input's packets lie together there, in order."""
    df = spark.range(600).selectExpr(
        "id % 200 as stream_id", "id as frame_id", "cast(id * 7 % 600 as double) as t",
        "cast(id % 2 as int) as out_index", "id % 3 = 0 as is_key", "id * 7 % 600 as dts",
    )
    recorders.record(df, method, f"{tmp_path}/out", folders=4)
    folders = list((tmp_path / f"out{part}").glob("folder=*"))
    assert 1 < len(folders) <= 4
    placed = []
    for folder in folders:
        rows = [r for p in sorted(folder.glob("*.parquet")) for r in spark.read.parquet(str(p)).collect()]
        changes = [r["stream_id"] for k, r in enumerate(rows) if not k or rows[k - 1]["stream_id"] != r["stream_id"]]
        assert len(changes) == len(set(changes))
        for k in range(1, len(rows)):
            if rows[k]["stream_id"] == rows[k - 1]["stream_id"]:
                assert rows[k]["dts"] > rows[k - 1]["dts"]
        placed += [(r["stream_id"], r["frame_id"]) for r in rows]
    assert sorted(placed) == sorted((n % 200, n) for n in range(600))
    one = rows_of_stream(spark, f"{tmp_path}/out{part}", 17, 4)
    assert sorted(r["frame_id"] for r in one.collect()) == [17, 217, 417]
    assert len({r["f"] for r in one.selectExpr("input_file_name() as f").collect()}) == 1
    assert "folder" not in one.columns


def test_packet_tables(spark, tmp_path):
    rows = [(1, 1, 0, "video", True, 0, 0, 4, 2, b"ab"), (1, 2, 1, "audio", None, 5, 5, None, None, b"c")]
    spark.createDataFrame(rows, PACKET_SCHEMA).write.parquet(f"{tmp_path}/packets")
    back = read_packets(spark, f"{tmp_path}/packets")
    assert back.schema == PACKET_SCHEMA and back.count() == 2
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.mp4").write_bytes(b"12345")
    found = media_files(spark, f"{tmp_path}/files", "*.mp4").collect()
    assert [(r["url"].endswith("/a.mp4"), r["length"]) for r in found] == [(True, 5)]


def test_methods_suit_inputs(spark):
    df = spark.createDataFrame(
        [(m, u) for m in ("interval", "percentage", "immediate", "specific_time") for u in ("rtmp://a", "a.mp4")],
        "m string, u string",
    )
    got = [r[0] for r in df.select(media.method_allowed("m", "u")).collect()]
    assert got == [True, True, False, True, True, False, False, True]
