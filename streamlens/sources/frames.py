"""Turning raw timestamped rows into frames with a per-stream clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from streamlens.functions.media import MICROS, pts_to_seconds
from streamlens.operators.cells import (
    CELL,
    DEFAULT_CELL_SECONDS,
    carry,
    clock,
    with_cell_width,
)

ORIGIN_SALTS = 16


def to_frames(
    df: DataFrame,
    stream: str = "stream_id",
    order: str = "frame_id",
    time: str = "ts",
    tb: tuple[int, int] = MICROS,
    cell_seconds: int = DEFAULT_CELL_SECONDS,
    keep_cells: bool = False,
) -> DataFrame:
    """Add ``pts`` (ticks of ``tb``) and ``t`` (seconds).

    A BIGINT ``time`` counts ticks of ``tb`` already and is taken as it is, as in packets. A
    timestamp counts from the stream's first row, whatever its media; ``tb`` is then
    microseconds. With ``keep_cells`` the operators that follow reuse the partitioning made here;
    without, rows meet their stream's origin by stream and salt, which Spark broadcasts where
    it is small, and which spreads the rows of a large stream where it is not.
    """
    named = df.withColumnsRenamed({stream: "stream_id", order: "frame_id"})
    rest = [c for c in named.columns if c not in ("pts", "t")]
    width = max(1, cell_seconds * tb[1] // tb[0])
    if isinstance(named.schema[time].dataType, IntegralType):
        ticked = named.withColumn("pts", F.col(time).cast("bigint"))
        frames = with_cell_width(ticked, "pts", width) if keep_cells else ticked
    elif keep_cells:
        started = carry(
            with_cell_width(named.withColumn("_tick", clock(named, time)), "_tick", width),
            ["stream_id"],
            [F.min("_tick").alias("_first")],
            lambda w: [F.min("_first").over(w.whole).alias("_origin")],
        )
        frames = started.withColumn("pts", F.col("_tick") - F.col("_origin"))
    else:
        ticked = named.withColumns(
            {"_tick": clock(named, time), "_salt": F.pmod(F.xxhash64("frame_id"), F.lit(ORIGIN_SALTS))}
        )
        firsts = ticked.groupBy("stream_id", "_salt").agg(F.min("_tick").alias("_first"))
        whole = Window.partitionBy("stream_id")
        origins = firsts.select("stream_id", "_salt", F.min("_first").over(whole).alias("_origin"))
        here = ticked.alias("rows").join(
            origins.withColumnsRenamed({"stream_id": "_stream", "_salt": "_its_salt"}),
            F.col("stream_id").eqNullSafe(F.col("_stream")) & (F.col("_salt") == F.col("_its_salt")),
        )
        frames = here.withColumn("pts", F.col("_tick") - F.col("_origin"))
    timed = frames.withColumn("t", pts_to_seconds("pts", *tb))
    return timed.select(*rest, "pts", "t", *([CELL] if keep_cells else []))


def stream_durations(frames: DataFrame, stream: str = "stream_id") -> DataFrame:
    """Duration of each stream in whole seconds, from its last frame of any media."""
    return frames.groupBy(stream).agg(F.max("t").cast("bigint").alias("duration"))


def video_only(frames: DataFrame) -> DataFrame:
    return frames.filter(F.col("media") == "video")
