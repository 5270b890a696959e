"""Frames, commands, layouts and requests derived from the ``events`` table.

An event is read as a frame of its user's stream, as a command on it, as an
entry of its mix layout, or as the content of a request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlens.functions.media import micros
from streamlens.operators.cells import measure_cell_seconds
from streamlens.sources.frames import to_frames

EVENTS_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,"
    " value double, props string"
)
#: Cells of events are no wider than this, however few rows they have.
MAX_CELL_SECONDS = 7 * 86_400
_measured: dict[tuple[str, str], int] = {}


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")


def cell_seconds(spark: SparkSession, sf_dir: str) -> int:
    """Cell width for these events, measured once per session; results do not depend on it."""
    place = (spark.sparkContext.applicationId, sf_dir)
    if place not in _measured:
        measured = measure_cell_seconds(read_events(spark, sf_dir), "user_id")
        _measured[place] = min(measured, MAX_CELL_SECONDS)
    return _measured[place]


def forget() -> None:
    """Measure widths of cells anew when they are next asked for."""
    _measured.clear()


def packets(events: DataFrame) -> DataFrame:
    """Events as packets in ticks of 1/90,000 second."""
    raw = raw_frames(events)
    ticks = F.call_function("div", micros("ts") * 9, F.lit(100))
    index = F.when(F.col("media") == "video", 0).when(F.col("media") == "audio", 1).otherwise(2)
    none = F.lit(None).cast("int")
    return raw.select(
        "stream_id",
        "frame_id",
        index.alias("stream_index"),
        "media",
        "is_key",
        ticks.alias("pts"),
        ticks.alias("dts"),
        none.alias("width"),
        none.alias("height"),
        F.col("size").cast("string").cast("binary").alias("data"),
    )


def raw_frames(events: DataFrame, *extra: Column | str) -> DataFrame:
    kind = F.col("event_type")
    media = (
        F.when(kind.isin("view", "click"), "video")
        .when(kind.isin("purchase", "signup"), "audio")
        .otherwise("data")
    )
    return events.select(
        F.col("user_id").alias("stream_id"),
        F.col("event_id").alias("frame_id"),
        "ts",
        media.alias("media"),
        (kind == "view").alias("is_key"),
        F.col("value").alias("size"),
        *extra,
    )


def frames(
    spark: SparkSession, sf_dir: str, *extra: Column | str, keep_cells: bool = False
) -> DataFrame:
    """All events as frames; cells are measured only where they are kept."""
    raw = raw_frames(read_events(spark, sf_dir), *extra)
    if not keep_cells:
        return to_frames(raw)
    return to_frames(raw, cell_seconds=cell_seconds(spark, sf_dir), keep_cells=True)


def video(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video frames, asked for by the stored column so that the file reader can skip others."""
    everything = frames(spark, sf_dir, "event_type")
    return everything.filter(F.col("event_type").isin("view", "click")).drop("event_type")


def commands(events: DataFrame) -> DataFrame:
    action = F.create_map(
        *[F.lit(x) for x in ("signup", "start", "error", "stop", "purchase", "update")]
    )
    return events.filter(F.col("event_type").isin("signup", "error", "purchase")).select(
        F.col("user_id").alias("stream_id"),
        "event_id",
        "ts",
        action[F.col("event_type")].alias("action"),
    )


def _with_k(events: DataFrame) -> DataFrame:
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def layout(events: DataFrame) -> DataFrame:
    """One entry per user, day and event type: the last event of it."""
    k = F.col("_e.k")
    return (
        _with_k(events)
        .select(
            F.col("user_id").alias("task_id"),
            F.col("ts").cast("date").alias("ver"),
            F.col("event_type").alias("id"),
            "ts",
            "event_id",
            "k",
        )
        .groupBy("task_id", "ver", "id")
        .agg(F.max(F.struct("ts", "event_id", "k")).alias("_e"))
        .select(
            "task_id",
            "ver",
            "id",
            F.concat(F.lit("rtmp://h/live/"), k % 3).alias("url"),
            (100 + k % 4).alias("width"),
            (50 + k % 2).alias("height"),
            (k % 5).alias("x"),
            F.lit(0).alias("y"),
            (k % 2).alias("z"),
            k.alias("k"),
        )
    )


def _quoted(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'"{name}":"'), value, F.lit('"'))


def _requests(events: DataFrame, *fields: Column) -> DataFrame:
    """Requests whose body has ``fields``; a NULL field is left out."""
    return _with_k(events).select(
        F.col("event_id").alias("req_id"),
        "ts",
        F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("body"),
    )


def _url() -> Column:
    live = F.concat(F.lit("rtmp://h/live/u"), "user_id")
    file = F.concat(F.lit("/data/vod/u"), "user_id", F.lit(".mp4"))
    return F.when(F.col("event_id") % 2 == 0, live).otherwise(file)


def _action() -> Column:
    return F.when(F.col("k") % 10 < 6, "start").when(F.col("k") % 10 < 9, "stop").otherwise("pause")


def screenshot_requests(events: DataFrame) -> DataFrame:
    methods = F.array(
        *[F.lit(m) for m in ("interval", "percentage", "immediate", "specific_time", "bogus")]
    )
    method = F.element_at(methods, F.col("k") % 5 + 1)
    param = F.element_at(
        F.array(F.lit("interval"), F.lit("percentage"), F.lit(None), F.lit("time_second")),
        F.when(F.col("k") % 5 < 4, F.col("k") % 5 + 1),
    )
    number = (F.floor("value") - 20).cast("string")
    return _requests(
        events,
        _quoted("stream_url", _url()),
        F.when(F.col("k") % 11 != 0, _quoted("method", method)),
        _quoted("action", _action()),
        F.concat(F.lit('"'), param, F.lit('":'), number),
    )


def recording_requests(events: DataFrame) -> DataFrame:
    methods = F.array(*[F.lit(m) for m in ("mp4", "mp4", "hls", "hls", "bogus")])
    suffixes = F.array(F.lit(".mp4"), F.lit(".m3u8"), F.lit(".avi"))
    name = F.concat(F.lit("rec"), F.element_at(suffixes, F.col("k") % 3 + 1))
    return _requests(
        events,
        _quoted("stream_url", _url()),
        F.when(F.col("k") % 11 != 0, _quoted("method", F.element_at(methods, F.col("k") % 5 + 1))),
        _quoted("action", _action()),
        _quoted("filename_name", name),
    )


def mix_requests(events: DataFrame) -> DataFrame:
    """One request per layout version; some entries lack a field or are not live."""
    k = F.col("k")
    live = F.when(k % 7 == 0, F.regexp_replace("url", "^rtmp", "http")).otherwise(F.col("url"))

    def plain(name: str, value: str) -> Column:
        return F.concat(F.lit(f'"{name}":'), value)

    entry = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            _quoted("id", F.col("id")),
            _quoted("url", live),
            *[plain(g, g) for g in ("width", "height", "x", "y")],
            F.when(k % 9 != 0, plain("z-index", "z")),
        ),
        F.lit("}"),
    )
    bodies = (
        layout(events)
        .withColumn("entry", entry)
        .groupBy("task_id", "ver")
        .agg(
            F.expr("listagg(entry, ',') WITHIN GROUP (ORDER BY id)").alias("entries"),
            (F.sum("k") % 10).cast("int").alias("h"),
        )
    )
    h = F.col("h")
    url = F.when(h == 1, F.lit("http://h/out")).otherwise(
        F.concat(F.lit("rtmp://h/out/u"), "task_id")
    )
    action = F.when(h == 9, "stop").when(h % 3 == 2, "update").otherwise("start")
    resolution = (
        F.when(h == 4, '"resolution":{"width":0,"height":360}')
        .when(h == 6, '"resolution":{"width":640}')
        .when(h != 0, '"resolution":{"width":640,"height":360}')
    )
    body = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            _quoted("output_url", url),
            _quoted("action", action),
            F.when(h != 3, _quoted("background_image", F.lit("bg.png"))),
            resolution,
            F.concat(F.lit('"streams":['), "entries", F.lit("]")),
        ),
        F.lit("}"),
    )
    day = F.unix_date("ver").cast("bigint")
    return bodies.select(
        (F.col("task_id") * 100_000 + day).alias("req_id"),
        F.col("ver").cast("timestamp_ntz").alias("ts"),
        body.alias("body"),
        "task_id",
        "ver",
        F.concat(F.lit("["), "entries", F.lit("]")).alias("streams"),
    )
