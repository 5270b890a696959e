import json

import pytest
from pyspark.sql import functions as F

from streamlens.operators import requests as rq


def check(spark, fn, bodies):
    texts = [b if isinstance(b, str) else json.dumps(b) for b in bodies]
    df = spark.createDataFrame(list(enumerate(texts)), "req_id bigint, body string")
    return [(r["code"], r["message"]) for r in fn(df).orderBy("req_id").collect()]


LIVE, FILE = "rtmp://h/a", "/data/a.mp4"


def shot(method="interval", url=LIVE, action="start", **rest):
    return {"stream_url": url, "method": method, "action": action, **rest}


def test_screenshot(spark):
    cases = [
        ("{broken", (2002, "Invalid JSON")),
        ("[1]", (2002, "Invalid JSON")),
        ({"stream_url": LIVE}, (2001, "Missing fields: Missing action")),
        ({"action": "start"}, (2001, "Missing fields: Missing method")),
        ({"action": "start", "method": "interval"}, (2001, "Missing fields: Missing stream_url")),
        (shot(action="update"), (2001, rq.INVALID_ACTION)),
        (shot(action=None), (2001, rq.INVALID_ACTION)),
        (shot("bogus", action="stop"), (1000, rq.SCREENSHOT_STOPPED)),
        (shot("percentage", percentage=5), (2001, rq.FILE_ONLY)),
        (shot("specific_time", time_second=5), (2001, rq.FILE_ONLY)),
        (shot("immediate", FILE), (2001, rq.LIVE_ONLY)),
        (shot("bogus"), (2001, rq.UNKNOWN_SCREENSHOT)),
        (shot(interval=0), (2001, rq.BAD_INTERVAL)),
        (shot(), (2001, rq.BAD_INTERVAL)),
        (shot(interval=1), (1000, rq.SCREENSHOT_STARTED)),
        (shot("percentage", FILE, percentage=0), (2001, rq.BAD_PERCENTAGE)),
        (shot("percentage", FILE, percentage=101), (2001, rq.BAD_PERCENTAGE)),
        (shot("percentage", FILE, percentage=100), (1000, rq.SCREENSHOT_STARTED)),
        (shot("specific_time", FILE, time_second=-1), (2001, rq.BAD_TIME)),
        (shot("specific_time", FILE, time_second=0), (1000, rq.SCREENSHOT_STARTED)),
        (shot("immediate"), (1000, rq.SCREENSHOT_STARTED)),
    ]
    assert check(spark, rq.validate_screenshot, [c for c, _ in cases]) == [w for _, w in cases]


def test_a_body_is_one_document(spark):
    good = ['{"a":1}', ' {"a":[1,{"b":"]"}]}\n', "[1]", '"x"', "1", '{"a":1,"a":2}', '{"a":"}],[{"}']
    bad = [None, "", " ", '{"a":1} x', '{"a":1}{"b":2}', '{"a":1},{"b":2}', '{"a":1', '{"a":1}]', '{"a":1}],[{"b":1}', '{"a":1},{"b":2}]',
           '{"a":1},0],[0', '{"a":1}}', '{"a":1}//c', "{'a':1}", "{a:1}", '{"a":tru}', '{"a":1,}', '{"a":01}']
    rows = spark.createDataFrame([(k, b) for k, b in enumerate([*good, *bad])], "k int, body string")
    found = [r[0] for r in rows.orderBy("k").select(rq.whole_document("body")).collect()]
    assert found == [True] * len(good) + [False] * len(bad)


def test_recording(spark):
    def rec(name="a.mp4", url=LIVE, method="mp4", action="start"):
        return {"stream_url": url, "method": method, "action": action, "filename_name": name}

    cases = [
        (rec("abcd"), (2001, rq.BAD_FILE_NAME)),  # four characters, no suffix
        (rec(".mp4"), (1000, rq.RECORDING_STARTED)),
        (rec("a.m3u8"), (1000, rq.RECORDING_STARTED)),  # suffix and method need not agree
        (rec("a.avi", FILE, "bogus"), (2001, rq.BAD_FILE_NAME)),
        ({k: v for k, v in rec().items() if k != "filename_name"}, (2001, rq.BAD_FILE_NAME)),
        (rec(url=FILE, method="bogus"), (2001, rq.RECORDING_LIVE_ONLY)),
        (rec(method="bogus"), (2001, rq.UNKNOWN_RECORDING)),
        (rec(action="stop", name="x"), (1000, rq.RECORDING_STOPPED)),
        (rec(action="go"), (2001, rq.INVALID_ACTION)),
    ]
    assert check(spark, rq.validate_recording, [c for c, _ in cases]) == [w for _, w in cases]


def test_mix(spark):
    good = {"id": "a", "url": LIVE, "width": 1, "height": 1, "x": 0, "y": 0, "z-index": 0}

    def mix(action="start", drop=(), **rest):
        body = {
            "output_url": "rtmp://h/out", "action": action, "background_image": "b.png",
            "resolution": {"width": 640, "height": 360}, "streams": [good], **rest,
        }
        return {k: v for k, v in body.items() if k not in drop}

    bad = [{**good, "url": FILE}, {"id": "b"}]
    cases = [
        ({"streams": []}, (2001, "Missing fields: Missing action")),
        ({"action": "start"}, (2001, "Missing fields: Missing output_url")),
        (mix(drop=["streams"]), (2001, "Missing fields: Missing streams")),
        (mix("stop"), (2001, rq.INVALID_ACTION)),
        (mix(drop=["resolution"], output_url=FILE), (2001, rq.NO_RESOLUTION)),
        (mix(output_url=FILE), (2001, rq.MIX_LIVE_ONLY)),
        (mix(resolution={"width": 1}), (2001, rq.RESOLUTION_PARTS)),
        (mix(resolution={"width": 1, "height": 0}), (2001, rq.RESOLUTION_SIZE)),
        (mix(streams=bad), (2001, rq.MIX_PARAMETERS)),
        (mix(drop=["background_image"]), (2001, rq.MIX_PARAMETERS)),
        (mix(), (1000, rq.MIX_STARTED)),
        (mix("update", output_url=FILE), (2001, rq.MIX_LIVE_ONLY)),
        (mix("update", streams=bad), (2001, rq.MIX_NO_STREAMS)),
        (mix("update", drop=["resolution", "background_image"]), (1000, rq.MIX_UPDATED)),
    ]
    assert check(spark, rq.validate_mix, [c for c, _ in cases]) == [w for _, w in cases]


@pytest.mark.parametrize("cell_seconds", [1, 10_000])
def test_answers_follow_the_running_tasks(spark, cell_seconds):
    steps = [
        (shot(interval=5, action="stop"), (2001, rq.SCREENSHOT_NOT_RUNNING)),
        (shot(interval=0), (2001, rq.BAD_INTERVAL)),
        (shot(interval=5), (1000, rq.SCREENSHOT_STARTED)),
        (shot(interval=9), (2001, rq.SCREENSHOT_RUNNING)),
        (shot("immediate"), (1000, rq.SCREENSHOT_STARTED)),
        ("oops", (2002, rq.INVALID_JSON_TEXT)),
        (shot(action="stop"), (1000, rq.SCREENSHOT_STOPPED)),
        (shot(action="stop"), (2001, rq.SCREENSHOT_NOT_RUNNING)),
    ]
    rows = [
        (n, f"2024-01-01 00:00:{n:02d}", b if isinstance(b, str) else json.dumps(b))
        for n, (b, _) in enumerate(steps)
    ]
    df = spark.createDataFrame(rows, "req_id bigint, at string, body string").selectExpr(
        "req_id", "cast(at as timestamp_ntz) as ts", "body"
    )
    got = rq.respond(df, "screenshot", cell_seconds=cell_seconds).orderBy("req_id").collect()
    assert [(r["code"], r["message"]) for r in got] == [w for _, w in steps]


def test_mix_answers(spark):
    good = {"id": "a", "url": LIVE, "width": 1, "height": 1, "x": 0, "y": 0, "z-index": 0}
    body = {
        "output_url": "rtmp://h/out", "background_image": "b.png", "streams": [good],
        "resolution": {"width": 640, "height": 360},
    }
    steps = [("update", (2001, rq.MIX_NOT_RUNNING)), ("start", (1000, rq.MIX_STARTED)),
             ("start", (2001, rq.MIX_RUNNING)), ("update", (1000, rq.MIX_UPDATED))]
    df = spark.createDataFrame(
        [(n, f"2024-01-01 00:00:0{n}", json.dumps({**body, "action": a})) for n, (a, _) in enumerate(steps)],
        "req_id bigint, at string, body string",
    ).selectExpr("req_id", "cast(at as timestamp_ntz) as ts", "body")
    got = rq.respond(df, "mix").orderBy("req_id").collect()
    assert [(r["code"], r["message"]) for r in got] == [w for _, w in steps]


def test_every_request_is_answered(spark):
    """Also one without a method or a time, which comes before all others of its task."""
    rows = [
        (1, "2024-01-01 00:00:01", json.dumps(shot(interval=1))),
        (2, None, json.dumps(shot(interval=1))),
        (3, "2024-01-01 00:00:02", json.dumps(shot(None, action="stop"))),
        (4, None, "oops"),
        (5, "2024-01-01 00:00:03", None),
    ]
    df = spark.createDataFrame(rows, "req_id bigint, at string, body string").selectExpr(
        "req_id", "cast(at as timestamp_ntz) as ts", "body"
    )
    got = {r["req_id"]: r["message"] for r in rq.respond(df, "screenshot").collect()}
    assert got == {
        1: rq.SCREENSHOT_RUNNING, 2: rq.SCREENSHOT_STARTED, 3: rq.SCREENSHOT_NOT_RUNNING,
        4: rq.INVALID_JSON_TEXT, 5: rq.INVALID_JSON_TEXT,
    }


def test_answers_carry_columns_along(spark):
    df = spark.createDataFrame(
        [(1, 1, '{"stream_url":"rtmp://a","method":"immediate","action":"start"}', "x"), (2, 2, "{", "y")],
        "req_id bigint, ts bigint, body string, code string",
    )
    whole = df.select("*", F.struct("code", "req_id").alias("own"))
    got = {(r["req_id"], r["code"], r["own"]["code"]) for r in rq.respond(whole, "screenshot", keep=["own"]).collect()}
    assert got == {(1, 1000, "x"), (2, 2002, "y")}
    assert rq.respond(df, "screenshot").columns == ["req_id", "code", "message"]
