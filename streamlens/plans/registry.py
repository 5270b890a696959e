"""The registered queries, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlens.checkpoints import fresh_path
from streamlens.functions.media import (
    RECORDING_METHODS,
    json_field_or_default,
    rescale_ts,
    url_basename,
)
from streamlens.operators import control, gaps, layout, recording, requests, sampling
from streamlens.operators.cells import measure_cell_seconds, number_rows
from streamlens.plans import event_tables as ev
from streamlens.plans import mixer, recorder, screenshot
from streamlens.sinks.commits import commit_batches, read_committed
from streamlens.sinks.frames import SHARED_FOLDERS, name_frames, push_stream
from streamlens.sinks.recorders import record
from streamlens.sources.frames import stream_durations, to_frames
from streamlens.sources.packets import (
    PACKET_SCHEMA,
    media_inventory,
    probe_streams,
    read_packet_stream,
    read_packets,
)
from streamlens.streaming import operators as live

DAY = 86_400
HALF_DAY = 43_200
MIX_STEP = (100_000, 3)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def frames_base(spark, sf):
    return ev.frames(spark, sf)


PACKET_TB = (1, 90_000)


def _packets(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as packets, by the packets' own schema, and read again."""
    path = fresh_path(spark, "packets")
    ev.packets(ev.read_events(spark, sf)).write.parquet(path)
    return read_packets(spark, path)


@query
def packet_frames(spark, sf):
    """Packets count ticks already, which become seconds without moving their origin."""
    timed = to_frames(_packets(spark, sf), time="pts", tb=PACKET_TB)
    return timed.select("stream_id", "frame_id", "stream_index", "media", "pts", "t")


@query
def packet_gap_sessions(spark, sf):
    return gaps.gap_sessions(
        _packets(spark, sf), HALF_DAY, "pts", ev.cell_seconds(spark, sf), tb=PACKET_TB
    )


@query
def written_frames(spark, sf):
    """Sampled frames written with their payload, and read back."""
    path = fresh_path(spark, "frames")
    kept = sampling.sample_interval(ev.video(spark, sf), DAY)
    frames = ev.raw_frames(ev.read_events(spark, sf))
    screenshot.save_screenshots(frames, kept, path, "size", folders=SHARED_FOLDERS)
    return spark.read.parquet(path).select(
        F.col("stream_id").cast("bigint").alias("stream_id"), "frame_id", "t", "size"
    )


@query
def written_recording(spark, sf):
    """Recordings written whole, and read back."""
    path = fresh_path(spark, "recording")
    record(recording_task(spark, sf), "mp4", path, folders=SHARED_FOLDERS)
    return spark.read.parquet(path).select(
        F.col("stream_id").cast("bigint").alias("stream_id"),
        "session_id", "frame_id", "out_index", "pts", "dts",
    )


@query
def written_segments(spark, sf):
    """Recordings written in segments; the playlist that lies beside them."""
    path = fresh_path(spark, "segments")
    record(_routed(spark, sf), "hls", path, seconds=DAY, folders=SHARED_FOLDERS)
    return spark.read.parquet(f"{path}/manifest")


@query
def probe_streams_(spark, sf):
    raw = ev.raw_frames(ev.read_events(spark, sf))
    return probe_streams(raw.withColumn("stream_index", F.col("frame_id")))


@query
def media_inventory_(spark, sf):
    return media_inventory(spark.read.parquet(f"{sf}/pages.parquet").select("url"))


@query
def media_inventory_requests(spark, sf):
    bodies = ev.recording_requests(ev.read_events(spark, sf))
    url = F.get_json_object("body", "$.stream_url")
    return media_inventory(bodies.select(url.alias("url")))


@query
def url_basename_(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.select("page_id", url_basename("url").alias("name"))


@query
def json_or_default(spark, sf):
    bodies = ev.screenshot_requests(ev.read_events(spark, sf))
    url = F.get_json_object("body", "$.stream_url")
    return bodies.select(
        "req_id",
        json_field_or_default("body", "method", F.lit("none")).alias("method"),
        json_field_or_default("body", "output_dir", url_basename(url)).alias("output_dir"),
    )


@query
def rescale_ts_(spark, sf):
    return ev.frames(spark, sf).select(
        "stream_id", "frame_id", rescale_ts("pts", (1, 1_000_000), (1, 90_000)).alias("pts_out")
    )


@query
def route_media_(spark, sf):
    routed = recording.route_media(ev.frames(spark, sf, keep_cells=True))
    return routed.select("stream_id", "frame_id", "media", "out_index")


@query
def route_media_by_index(spark, sf):
    """Each event type as an elementary stream of its own; one video and one audio are chosen."""
    events = ev.read_events(spark, sf)
    index = F.array_position(
        F.array(*[F.lit(x) for x in ("error", "click", "view", "signup", "purchase")]),
        F.col("event_type"),
    )
    indexed = ev.raw_frames(events, index.cast("int").alias("stream_index"))
    routed = recording.route_media(indexed, "ts", ev.cell_seconds(spark, sf))
    return routed.select("stream_id", "frame_id", "stream_index", "out_index")


@query
def name_frames_(spark, sf):
    kept = sampling.sample_interval(ev.video(spark, sf), DAY)
    folder = F.concat(F.lit("u"), "stream_id")
    return name_frames(kept, folder, "shot", cell_seconds=ev.cell_seconds(spark, sf)).drop("t")


@query
def screenshot_task(spark, sf):
    """The first frame at or after ten days of each stream's video, named."""
    return screenshot.screenshots(
        ev.frames(spark, sf),
        "specific_time",
        seconds=10 * DAY,
        cell_seconds=ev.cell_seconds(spark, sf),
    )


@query
def sample_interval(spark, sf):
    return sampling.sample_interval(ev.video(spark, sf), DAY)


@query
def sample_percentage(spark, sf):
    durations = stream_durations(ev.frames(spark, sf))
    return sampling.sample_percentage(ev.video(spark, sf), 10, durations)


@query
def sample_immediate(spark, sf):
    return sampling.sample_first(ev.video(spark, sf))


@query
def sample_immediate_drain(spark, sf):
    return sampling.sample_first(ev.video(spark, sf), drain=3)


def _first_key(df: DataFrame) -> DataFrame:
    return sampling.sample_first(df.filter("is_key"))


@query
def sample_registered(spark, sf):
    """A sampler of the user's own: the first key frame of each stream."""
    sampling.register_sampler("first_key", _first_key)
    return sampling.sample(ev.video(spark, sf), "first_key")


@query
def sample_at_time(spark, sf):
    return sampling.sample_at_time(ev.video(spark, sf), 10 * DAY)


@query
def sample_at_times(spark, sf):
    moments = F.array(*[F.lit(x) for x in (0, DAY, 1_000_000, 2_550_000)])
    wanted = (
        ev.read_events(spark, sf)
        .select(F.col("user_id").alias("stream_id"))
        .distinct()
        .withColumn("at", F.explode(moments))
    )
    return sampling.sample_at_times(ev.video(spark, sf), wanted, ev.cell_seconds(spark, sf))


@query
def command_outcome(spark, sf):
    return control.command_outcome(
        ev.commands(ev.read_events(spark, sf)), cell_seconds=ev.cell_seconds(spark, sf)
    )


@query
def sessions(spark, sf):
    return control.sessions_from_commands(
        ev.commands(ev.read_events(spark, sf)), cell_seconds=ev.cell_seconds(spark, sf)
    )


@query
def record_sessions(spark, sf):
    raw = ev.raw_frames(ev.read_events(spark, sf))
    return control.record_sessions(
        raw, sessions(spark, sf), cell_seconds=ev.cell_seconds(spark, sf)
    )


def _by_method(spark, sf):
    """Commands of two recording methods, so that an input may be recorded by both at once."""
    method = F.when(F.col("event_id") % 2 == 0, "mp4").otherwise("hls")
    return ev.commands(ev.read_events(spark, sf)).withColumn("method", method)


@query
def record_methods(spark, sf):
    """Frames of all recordings, where those of different methods overlap."""
    width = ev.cell_seconds(spark, sf)
    running = control.sessions_from_commands(
        _by_method(spark, sf), ["stream_id", "method"], cell_seconds=width
    )
    raw = ev.raw_frames(ev.read_events(spark, sf))
    return control.record_sessions(
        raw, running, cell_seconds=width, methods=RECORDING_METHODS
    )


@query
def recording_methods_task(spark, sf):
    """Packets of recordings by two methods at once, each choosing its own elementary streams."""
    packets = recorder.recorded_packets(
        ev.frames(spark, sf).withColumn("dts", F.col("pts")),
        _by_method(spark, sf),
        cell_seconds=ev.cell_seconds(spark, sf),
        per_recording=True,
        methods=RECORDING_METHODS,
    )
    return packets.select(
        "stream_id", "method", "session_id", "frame_id", "out_index", "pts", "dts"
    )


@query
def recording_task(spark, sf):
    """Packets of all recordings in the output time base."""
    events = ev.read_events(spark, sf)
    packets = recorder.recorded_packets(
        ev.frames(spark, sf).withColumn("dts", F.col("pts")),
        ev.commands(events),
        cell_seconds=ev.cell_seconds(spark, sf),
    )
    return packets.select("stream_id", "session_id", "frame_id", "out_index", "pts", "dts")


@query
def recording_of_damaged(spark, sf):
    """Recordings of packets and commands of which some lack their time or stream, with what was set aside."""
    path = fresh_path(spark, "damaged")
    events = ev.read_events(spark, sf)

    def damaged(rows: DataFrame, number: str) -> DataFrame:
        lost = {"ts": F.col(number) % 11 != 0, "stream_id": F.col(number) % 13 != 0}
        return rows.withColumns({name: F.when(known, F.col(name)) for name, known in lost.items()})

    raw, told = damaged(ev.raw_frames(events), "frame_id"), damaged(ev.commands(events), "event_id")
    recorder.record_inputs(raw, told, "mp4", path, ev.cell_seconds(spark, sf), SHARED_FOLDERS)

    def rows(part: str, number: str, session: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{part}").select(
            F.lit(part).alias("part"),
            F.col("stream_id").cast("bigint").alias("stream_id"),
            F.col(number).alias("number"),
            F.expr(session).alias("session_id"),
        )

    recorded = rows("mp4", "frame_id", "session_id")
    aside = rows("unplaced/packets", "frame_id", "CAST(NULL AS BIGINT)")
    return recorded.unionByName(aside).unionByName(rows("unplaced/commands", "event_id", "CAST(NULL AS BIGINT)"))


@query
def recording_rates(spark, sf):
    """Recordings of 25, 30 and 30000/1001 frames a second, each in the inverse of its rate."""
    width = ev.cell_seconds(spark, sf)
    media = ev.frames(spark, sf).filter(F.col("media") != "data")
    numbered = number_rows(
        media, "_n", ["ts", "frame_id"], width * 1_000_000, ("stream_id", "media")
    )
    ticks = F.element_at(F.array(*[F.lit(x) for x in (3600, 3000, 3003)]), (F.col("stream_id") % 3 + 1).cast("int"))
    pts = F.col("_n") * F.when(F.col("media") == "video", ticks).otherwise(1024)
    packets = recorder.recorded_packets(
        numbered.withColumns({"pts": pts, "dts": pts}).drop("_n"),
        ev.commands(ev.read_events(spark, sf)),
        (1, 90_000),
        (1, 44_100),
        cell_seconds=width,
        at_frame_rate=True,
    )
    return packets.select(
        "stream_id", "session_id", "frame_id", "out_index", "pts", "dts", "tb_num", "tb_den"
    )


@query
def active_task_profile(spark, sf):
    running = sessions(spark, sf)
    width = measure_cell_seconds(ev.read_events(spark, sf), None)
    return control.active_task_profile(running, cell_seconds=width)


@query
def gap_sessions(spark, sf):
    return gaps.gap_sessions(
        ev.raw_frames(ev.read_events(spark, sf)),
        HALF_DAY,
        cell_seconds=ev.cell_seconds(spark, sf),
    )


@query
def until_timeout(spark, sf):
    raw = ev.raw_frames(ev.read_events(spark, sf)).select("stream_id", "frame_id", "ts")
    return gaps.until_timeout(raw, HALF_DAY, cell_seconds=ev.cell_seconds(spark, sf))


def _routed(spark: SparkSession, sf: str) -> DataFrame:
    return recording.route_media(ev.frames(spark, sf, keep_cells=True))


@query
def assign_segments(spark, sf):
    cut = recording.assign_segments(_routed(spark, sf), DAY)
    return cut.select("stream_id", "frame_id", "segment_no")


@query
def segment_manifest(spark, sf):
    return recording.segment_manifest(_routed(spark, sf), DAY)


@query
def interleave(spark, sf):
    numbered = recording.interleave(_routed(spark, sf), "pts")
    return numbered.select("stream_id", "seq", "frame_id", "out_index")


@query
def estimate_frame_rate(spark, sf):
    return recording.estimate_frame_rate(ev.video(spark, sf))


@query
def saved_counts(spark, sf):
    video = ev.video(spark, sf)
    kept = {
        "interval": {"interval": DAY},
        "percentage": {"pct": 10, "duration": stream_durations(ev.frames(spark, sf))},
        "immediate": {},
        "specific_time": {"seconds": 10 * DAY},
    }
    parts = [
        sampling.sample(video, m, **params).select("stream_id", F.lit(m).alias("method"))
        for m, params in kept.items()
    ]
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part)
    return sampling.saved_counts(everything)


@query
def layout_diff(spark, sf):
    return layout.layout_diff(ev.layout(ev.read_events(spark, sf)))


@query
def layout_replay(spark, sf):
    return layout.layout_replay(ev.layout(ev.read_events(spark, sf)))


@query
def paint_order(spark, sf):
    return layout.paint_order(ev.layout(ev.read_events(spark, sf)))


@query
def explode_streams(spark, sf):
    bodies = ev.mix_requests(ev.read_events(spark, sf))
    return layout.explode_streams(bodies.select("req_id", "streams"))


@query
def mix_task(spark, sf):
    """What each accepted mix request changes against the one before."""
    bodies = ev.mix_requests(ev.read_events(spark, sf))
    accepted = mixer.accepted_requests(bodies, cell_seconds=ev.cell_seconds(spark, sf))
    return layout.layout_diff(mixer.layouts_of_requests(accepted))


@query
def mix_on_clock(spark, sf):
    """A tick every 33,333 1/3 seconds, a step that no binary fraction holds."""
    return layout.mix_on_clock(ev.frames(spark, sf), MIX_STEP)


@query
def validate_screenshot(spark, sf):
    return requests.validate_screenshot(ev.screenshot_requests(ev.read_events(spark, sf)))


@query
def validate_damaged(spark, sf):
    """Requests of which four in five are followed by something, cut short or closed once too often."""
    bodies = ev.screenshot_requests(ev.read_events(spark, sf))
    body, kind = F.col("body"), F.col("req_id") % 5
    damaged = (
        F.when(kind == 1, F.concat(body, F.lit(" trailing")))
        .when(kind == 2, F.concat(body, body))
        .when(kind == 3, body.substr(F.lit(1), F.length(body) - 1))
        .when(kind == 4, F.concat(body, F.lit("],["), body))
        .otherwise(F.concat(F.lit(" "), body, F.lit("\n")))
    )
    return requests.validate_screenshot(bodies.withColumn("body", damaged))


@query
def validate_recording(spark, sf):
    return requests.validate_recording(ev.recording_requests(ev.read_events(spark, sf)))


@query
def validate_mix(spark, sf):
    return requests.validate_mix(ev.mix_requests(ev.read_events(spark, sf)))


@query
def request_outcomes(spark, sf):
    return requests.request_outcomes(validate_screenshot(spark, sf))


@query
def screenshot_responses(spark, sf):
    bodies = ev.screenshot_requests(ev.read_events(spark, sf))
    return requests.respond(bodies, "screenshot", cell_seconds=ev.cell_seconds(spark, sf))


@query
def mix_responses(spark, sf):
    bodies = ev.mix_requests(ev.read_events(spark, sf))
    return requests.respond(bodies, "mix", cell_seconds=ev.cell_seconds(spark, sf))


@query
def recording_responses(spark, sf):
    bodies = ev.recording_requests(ev.read_events(spark, sf))
    return requests.respond(bodies, "recording", cell_seconds=ev.cell_seconds(spark, sf))


#: Parts in which a table comes to a live query, and the share of its time by which rows may be late.
PARTS, LATE = 4, 10
#: A time after which no stream goes on, in seconds.
OVER = 60 * DAY


def _in_parts(
    spark: SparkSession,
    table: DataFrame,
    time: str,
    job: Callable[[DataFrame, str], DataFrame],
    sink: Callable[[DataFrame], Callable[[DataFrame, int], None]] | None = None,
    state: str | None = None,
) -> DataFrame | None:
    """Run a live job over a table that comes in parts, with late rows, and then ends.

    ``state`` names the folder of the job's checkpoint.

    Rows come by their time and a delay of up to a tenth of the whole, so each part has rows that belong
    before others of the part before; the watermark given to the job allows for that. The job is started
    anew for each part and goes on from its checkpoint. The end is one far later row without a stream.
    """
    staged = fresh_path(spark, "staged")
    table.write.parquet(staged)
    whole = spark.read.schema(table.schema).parquet(staged)
    at = live.event_micros(table, time)
    low, high = whole.agg(F.min(at), F.max(at)).first()
    late = (high - low) // LATE + 1
    comes = at - low + F.pmod(F.xxhash64(*table.columns), F.lit(late))
    rows = whole.withColumn("_part", F.call_function("div", comes * PARTS, F.lit(high - low + late)))
    kind = table.schema[time].dataType
    years = F.max(F.col(time)) + (400 * DAY if kind.simpleString() == "double" else F.expr("INTERVAL 400 DAYS"))
    end = whole.agg(years.cast(kind).alias(time))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name != time]
    path, out = (fresh_path(spark, n) for n in ("live", "drained"))
    state = state or fresh_path(spark, "state")
    table.limit(0).write.parquet(path)
    source = read_packet_stream(spark, path, table.schema)
    cores = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with live.live_settings(spark, cores):
        sdf = job(source, f"{late // 1000 + 1} milliseconds")
        for k in range(PARTS + 1):
            new = rows.filter(F.col("_part") == k).drop("_part") if k < PARTS else end.select(time, *none)
            new.select(*table.columns).write.mode("append").parquet(path)
            push_stream(sdf, out if sink is None else sink(sdf), state, drain=True).awaitTermination()
    return spark.read.schema(sdf.schema).parquet(out) if sink is None else None


def _times(spark: SparkSession, sf: str) -> DataFrame:
    return ev.read_events(spark, sf).select(F.col("user_id").alias("stream_id"), "ts")


@query
def stream_sample_interval(spark, sf):
    frames = ev.video(spark, sf).select("stream_id", "frame_id", "t")
    return _in_parts(
        spark, frames, "t", lambda rows, late: live.stream_sample_interval(rows, DAY, late, bucket_seconds=DAY)
    )


@query
def stream_sample_first(spark, sf):
    frames = ev.video(spark, sf).select("stream_id", "frame_id", "t")
    return _in_parts(spark, frames, "t", lambda rows, late: live.stream_sample_first(rows, 0, late, bucket_seconds=DAY))


@query
def stream_gap_sessions(spark, sf):
    return _in_parts(spark, _times(spark, sf), "ts", lambda rows, late: live.stream_gap_sessions(rows, HALF_DAY, late))


@query
def stream_segments(spark, sf):
    return _in_parts(spark, _times(spark, sf), "ts", lambda rows, late: live.stream_segments(rows, DAY, late))


@query
def stream_commands(spark, sf):
    commands = ev.commands(ev.read_events(spark, sf))
    return _in_parts(spark, commands, "ts", lambda rows, late: live.stream_commands(rows, late, bucket_seconds=DAY))


@query
def stream_commands_ended(spark, sf):
    """A task whose commands stop coming for three days is stopped and forgotten."""
    commands = ev.commands(ev.read_events(spark, sf))
    return _in_parts(
        spark, commands, "ts",
        lambda rows, late: live.stream_commands(rows, late, bucket_seconds=DAY, idle_seconds=3 * DAY),
    )


@query
def stream_task_states(spark, sf):
    """Which tasks run, read from the state of the live query that judges their commands."""
    commands = ev.commands(ev.read_events(spark, sf))
    state = fresh_path(spark, "state")
    _in_parts(
        spark, commands, "ts", lambda rows, late: live.stream_commands(rows, late, bucket_seconds=DAY), state=state
    )
    return live.task_states(spark, state)


@query
def stream_packet_frames(spark, sf):
    """Packets as they arrive, by their own schema, in as many batches as there are files of them."""
    path, out = (fresh_path(spark, n) for n in ("packets", "drained"))
    ev.packets(ev.read_events(spark, sf)).repartition(PARTS, "frame_id").write.parquet(path)
    arriving = read_packet_stream(spark, path, PACKET_SCHEMA, maxFilesPerTrigger="1")
    timed = to_frames(arriving, time="pts", tb=PACKET_TB)
    frames = timed.select("stream_id", "frame_id", "stream_index", "media", "pts", "t")
    push_stream(frames, out, drain=True).awaitTermination()
    return spark.read.schema(frames.schema).parquet(out)


@query
def stream_layout(spark, sf):
    entries = ev.layout(ev.read_events(spark, sf))
    updates = entries.groupBy("task_id", "ver").agg(
        F.array_sort(F.collect_list(F.struct("id", "url", *layout.GEOMETRY))).alias("streams")
    )
    return _in_parts(spark, updates, "ver", lambda rows, late: live.stream_layout(rows, late, bucket_seconds=DAY))


@query
def stream_layout_ended(spark, sf):
    """When the updates of a mix end, what it still shows is removed."""
    entries = ev.layout(ev.read_events(spark, sf))
    updates = entries.groupBy("task_id", "ver").agg(
        F.array_sort(F.collect_list(F.struct("id", "url", *layout.GEOMETRY))).alias("streams")
    )
    return _in_parts(
        spark, updates, "ver",
        lambda rows, late: live.stream_layout(rows, late, bucket_seconds=DAY, idle_seconds=OVER),
    )


@query
def stream_manifest(spark, sf):
    """The playlist of live packets, cut at key frames; the last segment closes with its stream."""
    packets = _routed(spark, sf).select("stream_id", "frame_id", "t", "is_key")
    return _in_parts(
        spark, packets, "t",
        lambda rows, late: live.stream_manifest(rows, DAY, "out", late, bucket_seconds=DAY, idle_seconds=OVER),
    )


def _indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Frames with each event type as an elementary stream of its own."""
    kinds = F.array(*[F.lit(x) for x in ("error", "click", "view", "signup", "purchase")])
    frames = ev.frames(spark, sf, "event_type")
    index = F.array_position(kinds, F.col("event_type")).cast("int")
    return frames.withColumns({"stream_index": index, "dts": F.col("pts")}).drop("event_type")


@query
def recording_by_first_packets(spark, sf):
    """Recordings that each choose their elementary streams by their own first packets."""
    packets = recorder.recorded_packets(
        _indexed(spark, sf),
        ev.commands(ev.read_events(spark, sf)),
        cell_seconds=ev.cell_seconds(spark, sf),
        per_recording=True,
    )
    return packets.select("stream_id", "session_id", "frame_id", "out_index", "pts", "dts")


@query
def stream_recording(spark, sf):
    """Live packets and commands; every batch is given to the sink twice, as after a failure."""
    path = fresh_path(spark, "recording")
    frames = _indexed(spark, sf).select("stream_id", "ts", "frame_id", "media", "stream_index", "pts", "dts")
    commands = ev.commands(ev.read_events(spark, sf))
    both = frames.unionByName(commands, allowMissingColumns=True)
    schemas = []

    def job(rows: DataFrame, late: str) -> DataFrame:
        packets = rows.filter("media is not null")
        # the row that ends the input has neither
        switches = rows.filter("media is null")
        made = live.stream_recording(packets, switches, watermark=late, bucket_seconds=DAY)
        schemas.append(made.schema)
        return made

    def sink(sdf: DataFrame) -> Callable[[DataFrame, int], None]:
        write = commit_batches(spark, path, sdf.schema)

        def twice(batch: DataFrame, number: int) -> None:
            write(batch, number)
            write(batch, number)

        return twice

    _in_parts(spark, both, "ts", job, sink)
    return read_committed(spark, path, schemas[0])


def all_queries() -> dict[str, Query]:
    return {name.rstrip("_"): fn for name, fn in QUERIES.items()}
