import json
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import naive
from streamlens.operators import layout

COLUMNS = (
    "task_id bigint, ver int, id string, url string, width int, height int, x int, y int, z int"
)


@pytest.fixture(scope="module")
def histories():
    rng, out = random.Random(6), {}
    for task in range(30):
        versions = []
        for _ in range(rng.choice([1, 2, 12])):
            ids = rng.sample("abcdef", rng.randrange(1, 6))
            versions.append(
                [(i, f"rtmp://{rng.randrange(3)}", (rng.randrange(2), 1, 0, 0, rng.randrange(2))) for i in ids]
            )
        out[task] = versions
    return out


@pytest.fixture(scope="module")
def rows(spark, histories):
    # Version numbers have holes, as the numbers themselves mean nothing.
    data = [
        (task, ver * 3, i, u, *g)
        for task, versions in histories.items()
        for ver, streams in enumerate(versions)
        for i, u, g in streams
    ]
    random.Random(1).shuffle(data)
    return spark.createDataFrame(data, COLUMNS).cache()


@pytest.mark.parametrize("cell", [1, 5, 4096])
def test_diff_and_replay(rows, histories, cell):
    changes, urls = set(), set()
    for task, versions in histories.items():
        c, u = naive.replay(versions)
        changes |= {(task, ver * 3, i, change) for ver, i, change in c}
        urls |= {(task, ver * 3, i, url) for ver, i, url in u}
    got = layout.layout_diff(rows, cell).collect()
    assert {tuple(r) for r in got} == changes and len(got) == len(changes)
    got = layout.layout_replay(rows, cell).collect()
    assert {tuple(r)[:4] for r in got} == urls and len(got) == len(urls)


def test_url_alone_is_no_change(spark):
    df = spark.createDataFrame(
        [(1, 1, "a", "rtmp://old", 1, 1, 0, 0, 0), (1, 2, "a", "rtmp://new", 1, 1, 0, 0, 0)], COLUMNS
    )
    assert [r["change"] for r in layout.layout_diff(df).collect()] == ["unchanged"]
    assert {r["url_effective"] for r in layout.layout_replay(df).collect()} == {"rtmp://old"}


def test_stream_lists(spark):
    def entry(**changes):
        full = {"id": "a", "url": "rtmp://h/a", "width": 4, "height": 3, "x": 0, "y": 1, "z-index": 2}
        full.update(changes)
        return {k: v for k, v in full.items() if v is not ...}

    lists = [
        [entry(), entry(id="b", x=...), entry(id="c", url="http://h/c"), entry(id="d", **{"z-index": ...})],
        [],
        [entry(width=1), entry(id="e"), entry(width=9)],
    ]
    df = spark.createDataFrame(
        [(1, n, json.dumps(x)) for n, x in enumerate(lists)] + [(1, 3, "no list")],
        "task_id bigint, ver int, streams string",
    )
    got = layout.explode_streams(df)
    assert sorted((r["ver"], r["pos"], r["id"], r["width"], r["z"]) for r in got.collect()) == [
        (0, 0, "a", 4, 2), (2, 0, "a", 1, 2), (2, 1, "e", 4, 2), (2, 2, "a", 9, 2)
    ]
    last = layout.last_of_duplicates(got).collect()
    assert sorted((r["ver"], r["id"], r["width"]) for r in last) == [(0, "a", 4), (2, "a", 9), (2, "e", 4)]


def test_layers(spark):
    df = spark.createDataFrame(
        [(1, 1, "b", "", 0, 0, 0, 0, 1), (1, 1, "a", "", 0, 0, 0, 0, 1), (1, 1, "c", "", 0, 0, 0, 0, 0)],
        COLUMNS,
    )
    got = {r["id"]: r["layer"] for r in layout.paint_order(df).collect()}
    assert got == {"c": 0, "a": 1, "b": 2}


@pytest.mark.parametrize("cell", [1, 3, 1000])
def test_clock(spark, cell):
    rng, rows = random.Random(2), []
    for stream in range(20):
        for media in ("video", "audio"):
            t = rng.random() * 4
            for n in range(rng.choice([1, 5, 40])):
                rows.append((stream, media, len(rows), t))
                t += rng.choice([0.0, 0.1, 0.5, 6.0])
    rows = [(s, m, f, round(t * 1_000_000)) for s, m, f, t in rows]
    df = spark.createDataFrame(rows, "stream_id bigint, media string, frame_id bigint, pts bigint")
    for step, until in (((1, 2), (30, 1)), ((1, 2), None), ((1001, 3000), (30, 1)), ((1001, 3000), None)):
        got = layout.mix_on_clock(df, step, until, cell_ticks=cell).collect()
        size, want = Fraction(*step), set()
        for key in {(s, m) for s, m, _, _ in rows}:
            mine = sorted((Fraction(t, 1_000_000), f) for s, m, f, t in rows if (s, m) == key)
            end = Fraction(*until) // size if until else -(-mine[-1][0] // size)
            for k in range(end + 1):
                seen = [f for t, f in mine if t <= k * size]
                if seen:
                    want.add((*key, k * step[0] / step[1], seen[-1]))
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_clock_is_exact(spark):
    """Frames on the grid of 25 and 30 frames a second show on their own ticks, the last included."""
    for den, tb in ((25, (1, 90_000)), (30, (1, 90_000)), (10, (1, 1_000_000))):
        per = tb[1] // den
        df = spark.range(40_000).selectExpr("1L stream_id", "'video' media", "id frame_id", f"id * {per} pts")
        got = layout.mix_on_clock(df, (1, den), tb=tb)
        assert got.filter(F.col("tick") != F.col("frame_id") / float(den)).count() == 0
        assert got.count() == 40_000
        assert layout.mix_on_clock(df, (1, den), (1, 1), tb).count() == den + 1
