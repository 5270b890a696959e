"""Recording: choosing elementary streams, rescaling, interleaving, cutting into segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamlens.functions.media import (
    MICROS,
    TimeBase,
    best_ratio,
    rescale_ts,
    segment_file_name,
)
from streamlens.operators.cells import (
    CELL,
    DEFAULT_CELL_SECONDS,
    CellWindows,
    carry,
    number_rows,
    with_cell,
)

# Output index by media, and the length of a segment.
OUT_INDEX = {"video": 0, "audio": 1}
SEGMENT_SECONDS = 5

# Largest term of a frame rate; 60,000 / 1,001 is the largest in common use.
RATE_LIMIT = 60_000


def route_media(
    df: DataFrame,
    time: str = "t",
    cell_seconds: int = DEFAULT_CELL_SECONDS,
    keys: Sequence[str] = ("stream_id",),
    by_time: bool = False,
) -> DataFrame:
    """Keep the chosen video and audio rows of each input, with their output index.

    With a ``stream_index`` column the first video and the first audio stream of
    an input are chosen: those of the lowest index, or ``by_time`` those of the first packets.
    Without one each medium is a single stream. Inputs that
    have no video are left out, audio is optional. With a recording's id among the ``keys``, each
    recording chooses for itself.
    """
    video, audio = F.col("media") == "video", F.col("media") == "audio"
    index = F.col("stream_index") if "stream_index" in df.columns else F.lit(0)
    rank = F.struct(time, "frame_id", index.alias("i")) if by_time else index

    def first(name: str, w: CellWindows) -> Column:
        least = F.min(name).over(w.whole)
        return least["i"] if by_time else least

    routed = carry(
        with_cell(df.filter(video | audio), time, cell_seconds),
        keys,
        [
            F.min(F.when(video, rank)).alias("_video"),
            F.min(F.when(audio, rank)).alias("_audio"),
        ],
        lambda w: [
            first("_video", w).alias("_video_index"),
            first("_audio", w).alias("_audio_index"),
        ],
    )
    chosen = F.when(video, index == F.col("_video_index")).otherwise(
        index == F.col("_audio_index")
    )
    return (
        routed.filter(F.col("_video_index").isNotNull() & chosen)
        .withColumn(
            "out_index", F.when(video, OUT_INDEX["video"]).otherwise(OUT_INDEX["audio"])
        )
        .select(*df.columns, "out_index")
    )


def rescale_packets(
    df: DataFrame,
    video_tb: tuple[int, int],
    audio_tb: tuple[int, int],
    out_video_tb: TimeBase,
    out_audio_tb: TimeBase,
    audio_uses_video_tb: bool = False,
) -> DataFrame:
    """Move ``pts`` and ``dts`` of routed packets to the output time bases.

    Output time bases may be columns, such as those of ``with_time_base``.
    ``audio_uses_video_tb`` reads audio ticks in the video time base, for
    recordings that must line up with ones made that way.
    """
    audio_in = video_tb if audio_uses_video_tb else audio_tb
    is_video = F.col("out_index") == OUT_INDEX["video"]
    for name in ("pts", "dts"):
        df = df.withColumn(
            name,
            F.when(is_video, rescale_ts(name, video_tb, out_video_tb)).otherwise(
                rescale_ts(name, audio_in, out_audio_tb)
            ),
        )
    return df


def with_time_base(
    df: DataFrame,
    video_tb: tuple[int, int],
    audio_tb: tuple[int, int],
    keys: Sequence[str] = ("stream_id", "session_id"),
    limit: int = RATE_LIMIT,
) -> DataFrame:
    """Add the output time base of routed packets in cells, as ``tb_num`` and ``tb_den``.

    For video it is the inverse of the recording's frame rate: its frames but one over the ticks they span,
    as a fraction of terms up to ``limit``. Without a frame rate, and for audio, it is the
    input's own.
    """
    is_video = F.col("out_index") == OUT_INDEX["video"]
    shown = F.when(is_video, F.col("pts"))

    def rate(w: CellWindows) -> list[Column]:
        spans = F.max("_last").over(w.whole) - F.min("_first").over(w.whole)
        frames = F.sum("_n").over(w.whole) - 1
        ticks = [x.cast("decimal(20,0)") for x in (frames, spans)]
        ratio = best_ratio(ticks[0] * video_tb[1], ticks[1] * video_tb[0], limit)
        return [ratio.alias("_rate")]

    rated = carry(
        df,
        keys,
        [F.count(shown).alias("_n"), F.min(shown).alias("_first"), F.max(shown).alias("_last")],
        rate,
    )
    known = is_video & (F.col("_rate.num") > 0)

    def term(name: str, video: int, audio: int) -> Column:
        own = F.when(is_video, F.lit(video)).otherwise(F.lit(audio)).cast("bigint")
        return F.when(known, F.col(f"_rate.{name}")).otherwise(own)

    return rated.select(
        *df.columns,
        term("den", video_tb[0], audio_tb[0]).alias("tb_num"),
        term("num", video_tb[1], audio_tb[1]).alias("tb_den"),
    )


def interleave(
    df: DataFrame,
    order: str = "dts",
    tb: tuple[int, int] = MICROS,
    cell_seconds: int = DEFAULT_CELL_SECONDS,
) -> DataFrame:
    """Number the routed packets of an input in one time order over both media.

    Both media must count ``order`` in the same time base ``tb``. Kept cells are
    those of the presentation time, which decoding order need not follow.
    """
    if order == "dts":
        df = df.drop(CELL)
    width = max(1, cell_seconds * tb[1] // tb[0])
    return number_rows(df, "seq", [order, "out_index", "frame_id"], width)


def assign_segments(
    df: DataFrame, seconds: int = SEGMENT_SECONDS, t: str = "t", tiebreak: str = "frame_id"
) -> DataFrame:
    """Add ``segment_no``: segments begin at the first key frame of each ``seconds`` span.

    The first row of a stream begins one too. Per span of a stream it is enough
    to know its first key frame: rows before it still belong to the last segment
    begun earlier. Spans are found with partial aggregation, numbered with one
    row each, and joined back on ``(stream_id, span)``.
    """
    spanned = df.withColumn("_span", F.floor(F.col(t) / seconds).cast("bigint"))
    place = F.struct(t, tiebreak)
    spans = spanned.groupBy("stream_id", F.col("_span").alias(CELL)).agg(
        F.min(F.when(F.col("is_key"), place)).alias("_key"), F.min(place).alias("_head")
    )
    w = CellWindows.over(["stream_id"])
    begins = F.when(F.row_number().over(w.order) == 1, F.col("_head")).otherwise(F.col("_key"))
    begun = F.count("_begins").over(w.up_to)
    numbered = spans.withColumn("_begins", begins).select(
        "stream_id", F.col(CELL).alias("_span"), "_begins", begun.alias("_begun")
    )
    late = F.col("_begins").isNotNull() & (place < F.col("_begins"))
    number = F.col("_begun") - 1 - late.cast("int")
    return (
        spanned.join(numbered, ["stream_id", "_span"])
        .withColumn("segment_no", number.cast("bigint"))
        .select(*df.columns, "segment_no")
    )


def segment_manifest(
    df: DataFrame, seconds: int = SEGMENT_SECONDS, base: str = "out"
) -> DataFrame:
    """One playlist row per segment: its file name, time span and number of rows."""
    return manifest_of(assign_segments(df, seconds), base)


def manifest_of(cut: DataFrame, base: str = "out") -> DataFrame:
    """The playlist of rows that have their ``segment_no`` already."""
    return (
        cut.groupBy("stream_id", "segment_no")
        .agg(
            F.min("t").alias("start_t"),
            F.max("t").alias("end_t"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(
            "stream_id",
            "segment_no",
            segment_file_name(F.lit(base), "segment_no").alias("file_name"),
            "start_t",
            "end_t",
            (F.col("end_t") - F.col("start_t")).alias("duration"),
            "n",
        )
    )


def estimate_frame_rate(df: DataFrame) -> DataFrame:
    """Frames per second of each stream; NULL where its frames span no time."""
    span = F.max("t") - F.min("t")
    frames = (F.count(F.lit(1)) - 1).cast("double")
    return df.groupBy("stream_id").agg(F.try_divide(frames, span).alias("fps"))


def output_time_base(fps: DataFrame) -> DataFrame:
    """The seconds of one tick of the output, the inverse of its frame rate."""
    return fps.withColumn("tick_seconds", F.try_divide(F.lit(1.0), "fps"))
