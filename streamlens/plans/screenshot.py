"""Screenshots: keep frames by a rule, name them, then fetch and write their payload."""

from __future__ import annotations

from pyspark.sql import DataFrame

from streamlens.checkpoints import fresh_path
from streamlens.operators.cells import DEFAULT_CELL_SECONDS
from streamlens.operators.sampling import sample
from streamlens.sinks.frames import attach_payload, name_frames, write_frames
from streamlens.sources.frames import video_only


def screenshots(
    frames: DataFrame,
    method: str,
    dir: str = "screenshots",
    prefix: str = "frame",
    cell_seconds: int = DEFAULT_CELL_SECONDS,
    **params,
) -> DataFrame:
    """The named frames a screenshot task would save of each stream's video."""
    kept = sample(video_only(frames), method, **params)
    return name_frames(kept, dir, prefix, cell_seconds=cell_seconds)


def save_screenshots(
    frames: DataFrame, named: DataFrame, path: str, *payload: str, folders: int | None = None
) -> None:
    """Write the named frames with their payload, which only they are read for, by stream or into shared ``folders``.

    Names are written to the shared folder first, as payload is fetched in two steps that both read them.
    """
    spark = named.sparkSession
    names = fresh_path(spark, "named")
    named.write.parquet(names)
    written = spark.read.schema(named.schema).parquet(names)
    write_frames(attach_payload(written, frames, *payload), path, folders=folders)
