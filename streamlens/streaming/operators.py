"""The operators on live input. Each gives its batch operator's rows, in whatever batches rows come.

Rows may come out of order by as much as the watermark allows; stateful operators let them wait for
their turn (``ordered.py``), and rows later than that are dropped by the engine. With ``idle_seconds`` a
stream without rows for that long in event time is over: its close is emitted and its state goes.
Stateful operators use the RocksDB state store; ``use_rocksdb`` selects it. How
much a key may bring at once is set at the source (``maxFilesPerTrigger``,
``maxOffsetsPerTrigger``); samplers are cut down before the shuffle in any case.
Rows without a stream or a time have no place in any order and are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamlens.functions.media import MICROS, micros, segment_file_name
from streamlens.operators.gaps import READ_TIMEOUT_SECONDS
from streamlens.operators.recording import SEGMENT_SECONDS, rescale_packets
from streamlens.streaming.ordered import GROUP_COLUMN, LAST, MICROS_COLUMN, NULLS, OrderedProcessor
from streamlens.streaming.processors import (
    TASK_STATE,
    FirstSampler,
    IntervalSampler,
    LayoutState,
    Recorder,
    SegmentCutter,
    TaskState,
)

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EVENT = "event_time_"
WATERMARK = "10 seconds"
#: Where clocks that count from 0 begin, in microseconds.
CLOCK_BEGINS = 365 * 86_400_000_000
#: Seconds of event time that wait together in state.
BUCKET = 10
#: Into how many groups the keys of a live query are dealt; fixed when it first starts, and its tasks are no more.
GROUPS = 128


@contextmanager
def live_settings(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Settings that live queries need while they are started; the session's own come back after.

    The number of ``partitions`` of a query's state is fixed when it first starts.
    """
    wanted = {_PROVIDER: _ROCKSDB, _MERGE: "true"}
    if partitions is not None:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(_PROVIDER, _ROCKSDB)


def merge_sessions_before_shuffle(spark: SparkSession) -> None:
    """Let each task join the rows of a session first, so a busy stream sends few of them."""
    spark.conf.set(_MERGE, "true")


def _first_of(sdf: DataFrame, keys: list[str], count: int) -> DataFrame:
    """Cut each input batch down to the first rows per key before they are shuffled.

    A row of the same batch, key and second that comes earlier would be kept
    instead of a later one, so the later ones can go before the state is asked.
    """
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.sort_values(["t", "frame_id"]).groupby(keys, sort=False, dropna=False).head(count)

    return sdf.mapInPandas(cut, sdf.schema)


def event_micros(df: DataFrame, time: str) -> Column:
    """A time column as microseconds.

    Numbers count seconds of a stream's own clock. That is set to begin in 1971, as the engine's first
    watermark is the beginning of 1970 and rows at it are late.
    """
    kind, value = df.schema[time].dataType, F.col(time)
    if isinstance(kind, T.TimestampNTZType):
        return micros(value)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("bigint") * 86_400_000_000
    seconds = value.cast("bigint") if isinstance(kind, T.IntegralType) else value
    return F.floor(seconds * 1_000_000).cast("bigint") + CLOCK_BEGINS


def _in_order(
    sdf: DataFrame, time: str, watermark: str, processor: OrderedProcessor, schema: str | T.StructType
) -> DataFrame:
    """Rows by groups of keys in event-time order through a processor."""
    key = processor.key
    processor.key_type = sdf.schema[key].dataType.simpleString()
    timed = sdf.withColumn(MICROS_COLUMN, event_micros(sdf, time))
    marked = timed.withColumn(_EVENT, F.timestamp_micros(MICROS_COLUMN)).withWatermark(_EVENT, watermark)
    # The filter names the event time, which keeps it above the watermark: rows without a stream move it on.
    placed = marked.filter(F.when(F.col(_EVENT).isNotNull(), F.col(key).isNotNull()))
    numbers = [f.name for f in sdf.schema if isinstance(f.dataType, T.IntegralType) and f.name != key]
    flags = {n + NULLS: F.col(n).isNull() for n in numbers}
    whole = {n: F.coalesce(n, F.lit(0).cast(sdf.schema[n].dataType)) for n in numbers}
    group = F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int")
    dealt = placed.withColumns(flags).withColumns({**whole, GROUP_COLUMN: group})
    return dealt.groupBy(GROUP_COLUMN).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="EventTime"
    )


def _ms(seconds: float | None) -> int | None:
    return None if seconds is None else int(seconds * 1000)


def _typed(sdf: DataFrame, *names: str) -> str:
    """Names with the types that ``sdf`` has for them, as a schema."""
    return ", ".join(f"{n} {sdf.schema[n].dataType.simpleString()}" for n in names)


def stream_sample_interval(
    sdf: DataFrame,
    interval: int,
    watermark: str = WATERMARK,
    time: str = "t",
    bucket_seconds: float = BUCKET,
    idle_seconds: float | None = None,
) -> DataFrame:
    """``sample_interval`` on a live stream; the state is one number per stream."""
    if interval <= 0:
        raise ValueError("Interval must be positive.")
    frames = sdf.filter(F.col("t").isNull() | (F.col("t") >= interval) | F.col("stream_id").isNull())
    columns = list(dict.fromkeys(["stream_id", "frame_id", "t", time]))
    frames = frames.select(*columns, F.floor("t").cast("bigint").alias("_second"))
    cut = _first_of(frames, ["stream_id", "_second"], 1).drop("_second")
    schema = _typed(cut, "stream_id", "frame_id", "t")
    processor = IntervalSampler(interval, _ms(bucket_seconds), _ms(idle_seconds))
    return _in_order(cut, time, watermark, processor, schema)


def stream_sample_first(
    sdf: DataFrame,
    drain: int = 0,
    watermark: str = WATERMARK,
    time: str = "t",
    bucket_seconds: float = BUCKET,
    idle_seconds: float | None = None,
) -> DataFrame:
    """``sample_first`` on a live stream."""
    frames = sdf.select(*dict.fromkeys(["stream_id", "frame_id", "t", time]))
    cut = frames if idle_seconds is not None else _first_of(frames, ["stream_id"], 1 + drain)
    schema = _typed(cut, "stream_id", "frame_id", "t")
    processor = FirstSampler(1 + drain, _ms(bucket_seconds), _ms(idle_seconds))
    return _in_order(cut, time, watermark, processor, schema)


def stream_commands(
    sdf: DataFrame,
    watermark: str = WATERMARK,
    time: str = "ts",
    bucket_seconds: float = BUCKET,
    idle_seconds: float | None = None,
) -> DataFrame:
    """``command_outcome`` on a live command stream.

    A task that still runs when its commands end is stopped by a row of action ``end`` without an id.
    """
    commands = sdf.select("stream_id", "event_id", "action", time)
    schema = f"{_typed(commands, 'stream_id', 'event_id')}, action string, outcome string"
    processor = TaskState(_ms(bucket_seconds), _ms(idle_seconds))
    return _in_order(commands, time, watermark, processor, schema)


def task_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Whether each task runs now, from the state that ``stream_commands`` keeps in its ``checkpoint``.

    The state of the last finished micro-batch is read, by as many tasks as it has partitions; the live
    query itself goes on. Commands that still wait for their turn do not count yet.
    """
    state = spark.read.format("statestore").option("stateVarName", TASK_STATE).load(checkpoint)
    return state.select("list_element.*").drop(LAST)


def stream_layout(
    sdf: DataFrame,
    watermark: str = WATERMARK,
    time: str = "ver",
    bucket_seconds: float = BUCKET,
    idle_seconds: float | None = None,
) -> DataFrame:
    """``layout_diff`` on live updates; a row is one update with its full stream list.

    When the updates of a mix end, what it still shows is removed, in rows without a version.
    """
    updates = sdf.select(*dict.fromkeys(["task_id", "ver", "streams", time]))
    schema = f"{_typed(updates, 'task_id', 'ver')}, id string, change string"
    processor = LayoutState(_ms(bucket_seconds), _ms(idle_seconds))
    return _in_order(updates, time, watermark, processor, schema)


def stream_recording(
    packets: DataFrame,
    commands: DataFrame,
    tbs: tuple[tuple[int, int], ...] = (MICROS, MICROS, (1, 90_000), (1, 90_000)),
    watermark: str = WATERMARK,
    bucket_seconds: float = BUCKET,
    idle_seconds: float | None = None,
) -> DataFrame:
    """Packets of each recording, routed and in the output time bases, while they come.

    ``commands`` start and stop the recording of a stream. The first video and the first audio packet
    of a recording choose its elementary streams. ``tbs`` are the time bases of video and audio, in
    and out. Write it with ``commit_batches``, which a repeated batch does not write twice.
    """
    numbers = ["stream_index", "pts", "dts"]
    rows = packets.select(
        "stream_id", "ts", F.lit(1).alias("kind_"), F.col("frame_id").cast("bigint").alias("order_"), F.lit("").alias("action"),
        "media", "frame_id", *numbers,
    )
    # no nulls among numbers: they would come to the processor as doubles
    none = [F.lit(0).cast(rows.schema[n].dataType).alias(n) for n in ("frame_id", *numbers)]
    switches = commands.filter(F.col("stream_id").isNull() | F.col("action").isin("start", "stop")).select(
        "stream_id", "ts", F.lit(0).alias("kind_"), F.col("event_id").cast("bigint").alias("order_"), "action",
        F.lit("").alias("media"), *none,
    )
    kept = ["stream_id", "frame_id", "pts", "dts"]
    schema = f"session_id bigint, out_index int, {_typed(rows, *kept)}"
    processor = Recorder(kept, _ms(bucket_seconds), _ms(idle_seconds))
    routed = _in_order(rows.unionByName(switches), "ts", watermark, processor, schema)
    return rescale_packets(routed, *tbs).select("stream_id", "session_id", "frame_id", "out_index", "pts", "dts")


def stream_manifest(
    sdf: DataFrame,
    seconds: int = SEGMENT_SECONDS,
    base: str = "out",
    watermark: str = WATERMARK,
    time: str = "t",
    bucket_seconds: float = BUCKET,
    idle_seconds: float | None = None,
) -> DataFrame:
    """``segment_manifest`` on live routed packets: a segment's row comes when the next one begins.

    The last segment's row comes when the stream is over, which takes ``idle_seconds``.
    """
    rows = sdf.select(*dict.fromkeys(["stream_id", "frame_id", "t", "is_key", time]))
    schema = f"{_typed(rows, 'stream_id')}, segment_no bigint, start_t double, end_t double, n bigint"
    processor = SegmentCutter(seconds, _ms(bucket_seconds), _ms(idle_seconds))
    closed = _in_order(rows, time, watermark, processor, schema)
    return closed.select(
        "stream_id", "segment_no", segment_file_name(F.lit(base), "segment_no").alias("file_name"),
        "start_t", "end_t", (F.col("end_t") - F.col("start_t")).alias("duration"), "n",
    )


def with_event_time(sdf: DataFrame, time: str, watermark: str) -> DataFrame:
    """Watermarks need an instant, so a zone-free time is read as UTC."""
    return sdf.withColumn(_EVENT, F.timestamp_micros(micros(time))).withWatermark(
        _EVENT, watermark
    )


def _zone_free(instant: Column) -> Column:
    start = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), start)


def stream_gap_sessions(
    sdf: DataFrame,
    gap: float = READ_TIMEOUT_SECONDS,
    watermark: str = "10 seconds",
    time: str = "ts",
) -> DataFrame:
    """``gap_sessions`` on a live stream, without numbers: a session is out once it is over."""
    session = F.session_window(_EVENT, f"{int(gap * 1_000_000)} microseconds")
    return (
        with_event_time(sdf.select("stream_id", time), time, watermark)
        .groupBy("stream_id", session.alias("_session"))
        .agg(
            F.min(_EVENT).alias("_first"),
            F.max(_EVENT).alias("_last"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(
            "stream_id",
            _zone_free(F.col("_first")).alias("start_ts"),
            _zone_free(F.col("_last")).alias("last_ts"),
            "n",
        )
    )


def stream_segments(
    sdf: DataFrame,
    seconds: int = SEGMENT_SECONDS,
    watermark: str = "10 seconds",
    time: str = "ts",
) -> DataFrame:
    """Rows per fixed span of the clock, out once the span is over.

    ``stream_manifest`` cuts at key frames.
    """
    return (
        with_event_time(sdf.select("stream_id", time), time, watermark)
        .groupBy("stream_id", F.window(_EVENT, f"{seconds} seconds").alias("_window"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "stream_id",
            _zone_free(F.col("_window.start")).alias("window_start"),
            _zone_free(F.col("_window.end")).alias("window_end"),
            "n",
        )
    )
