"""Naming and writing kept frames, and publishing streams of rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from streamlens.checkpoints import fresh_path
from streamlens.operators.cells import DEFAULT_CELL_SECONDS, number_rows, ticks_per_second

# Marks by which payload is chosen before it is shuffled: at most a million words of 64 bits are broadcast.
PAYLOAD_MARKS = 1 << 26
#: The column that names the folder of inputs that share one.
FOLDER = "folder"
#: Folders for tables of very many inputs.
SHARED_FOLDERS = 64


def name_frames(
    df: DataFrame,
    dir: str | Column,
    prefix: str,
    ext: str = "png",
    cell_seconds: int = DEFAULT_CELL_SECONDS,
) -> DataFrame:
    """Number the kept frames of each stream from 0 in time order and name their files."""
    width = cell_seconds * ticks_per_second(df, "t")
    numbered = number_rows(df, "frame_no", ["t", "frame_id"], width)
    folder = F.lit(dir) if isinstance(dir, str) else dir
    path = F.format_string(f"%s/{prefix}_%d.{ext}", folder, "frame_no")
    rest = [c for c in df.columns if c not in ("stream_id", "frame_id", "t")]
    return numbered.select("stream_id", "frame_id", "frame_no", path.alias("path"), *rest)


def folder_of(df: DataFrame, folders: int | None) -> tuple[str, DataFrame]:
    """The column that names each row's folder, and the rows with it.

    Without a number it is the input itself. A folder costs a store several calls when it is written,
    and again when it is listed and read, so many inputs are dealt to so many ``folders`` by a hash of their id, which
    is then a column of the files. ``rows_of_stream`` reads an input's rows from its folder alone.
    """
    if folders is None:
        return "stream_id", df
    name, taken = FOLDER, {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name, df.withColumn(name, _dealt(F.col("stream_id"), folders))


def _dealt(stream: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(stream.cast("string")), F.lit(folders)).cast("int")


def rows_of_stream(spark: SparkSession, path: str, stream: int | str, folders: int) -> DataFrame:
    """What was written of one input into shared ``folders``; the others are not read."""
    written = spark.read.parquet(path)
    # the folder is the last column
    name = written.columns[-1]
    here = (F.col(name) == _dealt(F.lit(stream), folders)) & (F.col("stream_id") == F.lit(stream))
    return written.filter(here).drop(name)


def write_frames(df: DataFrame, path: str, mode: str = "errorifexists", folders: int | None = None) -> None:
    """Write kept frames, payload included, into one folder per stream.

    Rebalancing brings a stream's frames together, to write few files, and splits
    a stream that is too large for one task. Many streams can share a number of ``folders``, see ``folder_of``.
    """
    name, dealt = folder_of(df, folders)
    dealt.hint("rebalance", name).write.mode(mode).partitionBy(name).parquet(path)


def attach_payload(
    kept: DataFrame, frames: DataFrame, *payload: str, marks: int = PAYLOAD_MARKS
) -> DataFrame:
    """Payload columns of the kept frames only; sampling itself never reads them.

    Payload that no kept frame asks for is left out before it is shuffled, see ``marked``. ``kept``
    is read twice and should be a written table where it is dear to make.
    """
    wanted = marked(kept, frames.select("stream_id", "frame_id", *payload), marks)
    return kept.join(wanted, ["stream_id", "frame_id"])


def marked(kept: DataFrame, frames: DataFrame, marks: int = PAYLOAD_MARKS) -> DataFrame:
    """The frames that may be among ``kept``: all that are, and few others while marks are sparse.

    Each kept frame sets one of ``marks`` bits by the hash of its key. The words of these bits, at most
    ``marks / 64`` however many frames are kept, are broadcast and looked up where frames are read, so
    frames are neither shuffled nor sorted for it. More kept frames than bits only let more frames through.
    """
    keys = ["stream_id", "frame_id"]
    # equal keys of different types must have equal hashes
    common = kept.select(*keys).unionByName(frames.select(*keys)).schema
    place = F.pmod(F.xxhash64(*[F.col(k).cast(common[k].dataType) for k in keys]), F.lit(marks))
    word, bit = F.shiftright(place, 6), (place % 64).cast("int")
    words = (
        kept.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("_bit"))
        .groupBy("_word")
        .agg(F.bit_or("_bit").alias("_bits"))
    )
    found = frames.withColumns({"_word": word, "_at": bit}).join(F.broadcast(words), "_word")
    return found.filter(F.getbit("_bits", F.col("_at")) == 1).select(*frames.columns)


def push_stream(
    sdf: DataFrame,
    sink: str | Callable[[DataFrame, int], None],
    checkpoint: str | None = None,
    fmt: str = "parquet",
    mode: str = "append",
    drain: bool = False,
    **options: str,
) -> StreamingQuery:
    """Publish a stream to a folder or topic (``fmt``) or to a function of each batch.

    ``drain`` handles everything that is there already and then ends, emitting
    what is still buffered; otherwise the query runs until it is stopped, and needs a
    ``checkpoint`` folder to go on from when it is started again.
    """
    if checkpoint is None:
        if not drain:
            raise ValueError("A query that goes on needs a checkpoint folder.")
        checkpoint = fresh_path(sdf.sparkSession, "push")
    writer = sdf.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if drain:
        writer = writer.trigger(availableNow=True)
    if callable(sink):
        return writer.foreachBatch(sink).start()
    return writer.format(fmt).options(**options).start(sink)
