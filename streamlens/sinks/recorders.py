"""Writing recordings: one ordered output per input, whole or in segments with a manifest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from streamlens.operators.recording import SEGMENT_SECONDS, assign_segments, manifest_of
from streamlens.sinks.frames import folder_of


def write_single(
    df: DataFrame, path: str, order: str = "dts", mode: str = "errorifexists", folders: int | None = None
) -> None:
    """One output folder per input whose files, in name order, hold its packets in time order.

    Packets are range-partitioned by input and time, so a large input is spread
    over several tasks, each writing one stretch of it. Many inputs can share a number of ``folders``, see
    ``folder_of``; the packets of each then lie together, in time order.
    """
    _write_ordered(df, path, ["stream_id", order, "out_index"], mode, folders)


def _write_ordered(df: DataFrame, path: str, place: list[str], mode: str, folders: int | None) -> None:
    name, dealt = folder_of(df, folders)
    place = list(dict.fromkeys([name, *place]))
    (
        dealt.repartitionByRange(*place)
        .sortWithinPartitions(*place)
        .write.mode(mode)
        .partitionBy(name)
        .parquet(path)
    )


def write_segments(
    df: DataFrame,
    path: str,
    seconds: int = SEGMENT_SECONDS,
    base: str = "out",
    mode: str = "errorifexists",
    folders: int | None = None,
) -> None:
    """One output folder per input, sorted by segment, and the playlist of all segments beside it.

    Packets are range-partitioned by input, segment and time, so many short segments share a
    file, a long one is spread over several tasks, and readers of a segment skip the row groups
    of others. The playlist is made from what was written, not by cutting the packets again.
    Many inputs can share a number of ``folders``, as in ``write_single``.
    """
    cut = assign_segments(df, seconds)
    _write_ordered(cut, f"{path}/segments", ["stream_id", "segment_no", "t", "out_index"], mode, folders)
    written = df.sparkSession.read.schema(cut.schema).parquet(f"{path}/segments")
    manifest_of(written, base).write.mode(mode).parquet(f"{path}/manifest")


_RECORDERS: dict[str, Callable[..., None]] = {"mp4": write_single, "hls": write_segments}


def register_recorder(name: str, fn: Callable[..., None]) -> None:
    _RECORDERS[name] = fn


def record(df: DataFrame, method: str, path: str, **options) -> None:
    """Write routed packets the way ``method`` names."""
    if method not in _RECORDERS:
        raise ValueError("Invalid recording method.")
    _RECORDERS[method](df, path, **options)
