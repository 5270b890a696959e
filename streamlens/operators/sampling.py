"""Choosing frames of each stream: by interval, by share, first, or at given times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamlens.functions.media import progress_percent
from streamlens.operators.cells import (
    DEFAULT_CELL_SECONDS,
    carry,
    in_cell,
    with_cell,
)
from streamlens.operators.greedy import (
    HIGHEST_SHARE,
    interval_walk,
    near_share_walk,
    share_walk,
    walk_in_order,
)
from streamlens.sources.frames import ORIGIN_SALTS

# How many bins 100 percent of a file are cut into.
SHARE_BINS = 1_000_000


def sample_interval(
    df: DataFrame,
    interval: int,
    stream: str = "stream_id",
    t: str = "t",
    tiebreak: str = "frame_id",
) -> DataFrame:
    """Frames at least ``interval`` seconds after the last kept one.

    The time of the last kept frame counts in whole seconds, from 0. The next
    frame is therefore due at a whole second, and if any frame of a second is
    kept it is the second's first. Streams are first cut down to one row per
    second, with partial aggregation, and only those rows are walked in order.
    """
    if interval <= 0:
        raise ValueError("Interval must be positive.")
    seconds = (
        df.filter(F.col(t) >= interval)
        .groupBy(stream, F.floor(t).cast("bigint").alias("_second"))
        .agg(F.min(F.struct(t, tiebreak)).alias("_first"))
        .select(stream, "_second", F.col(f"_first.{tiebreak}"), F.col(f"_first.{t}"))
    )
    kept = walk_in_order(seconds, stream, ["_second"], interval_walk(interval), seconds.schema)
    return kept.select(stream, tiebreak, t)


def sample_percentage(
    df: DataFrame,
    pct: int,
    duration: DataFrame,
    stream: str = "stream_id",
    t: str = "t",
    tiebreak: str = "frame_id",
    bins: int = SHARE_BINS,
) -> DataFrame:
    """Frames at least ``pct`` percent of the file after the last kept one.

    ``duration`` has one row per stream; its fraction of a second is dropped.
    Streams are first cut down, with partial aggregation, to the lowest and highest
    share of each of ``bins`` bins in 100 percent. From these alone follows which bins
    a kept row can be in; with n rows to keep, about ``n * n / 2`` of the bins where
    frames lie close, and just the kept ones where they do not. Only the first frame of
    each share in those bins is walked in order. Results do not depend on ``bins``.
    """
    if not 1 <= pct <= 100:
        raise ValueError("Percentage must be between 1 and 100.")
    if bins < 200:
        raise ValueError("Bins must be narrower than one percent.")
    shared = _with_share(df.select(stream, tiebreak, t), duration, stream, t, tiebreak)
    bin_of = F.floor(F.least("pct", F.lit(HIGHEST_SHARE)) * F.lit(bins / 100))
    shared = shared.filter((F.col("pct") >= pct) & ~F.isnan("pct")).withColumn("_bin", bin_of)
    summary = shared.groupBy(stream, "_bin").agg(
        F.min("pct").alias("_low"), F.max("pct").alias("_high")
    )
    near = walk_in_order(
        summary, stream, ["_bin"], near_share_walk(pct), summary.select(stream, "_bin").schema
    ).withColumnsRenamed({stream: "_stream", "_bin": "_near"})
    possible = (
        shared.join(
            near,
            F.col(stream).eqNullSafe(F.col("_stream")) & (F.col("_bin") == F.col("_near")),
            "left_semi",
        )
        .groupBy(stream, "pct")
        .agg(F.min(F.struct(t, tiebreak)).alias("_first"))
        .select(stream, "pct", F.col(f"_first.{tiebreak}"), F.col(f"_first.{t}"))
    )
    kept = walk_in_order(possible, stream, ["pct"], share_walk(pct), possible.schema)
    return kept.select(stream, tiebreak, t, "pct")


def _with_share(rows, duration, stream, t, tiebreak) -> DataFrame:
    """Rows with ``pct``, how much of their file lies before them; NULL where that is unknown.

    Rows meet their stream's duration by stream and salt, as they do their origin. In a
    file of no whole second every frame after 0 is infinitely far.
    """
    salt = F.pmod(F.xxhash64(tiebreak), F.lit(ORIGIN_SALTS))
    totals = duration.select(
        F.col(stream).alias("_stream"), F.col("duration").cast("bigint").alias("_total")
    ).withColumn("_its_salt", F.explode(F.sequence(F.lit(0), F.lit(ORIGIN_SALTS - 1))))
    share = F.when(F.col("_total") > 0, progress_percent(t, "_total")).when(
        (F.col("_total") == 0) & (F.col(t) > 0), F.lit(float("inf"))
    )
    return (
        rows.withColumn("_salt", salt)
        .join(
            totals,
            F.col(stream).eqNullSafe(F.col("_stream")) & (F.col("_salt") == F.col("_its_salt")),
        )
        .select(stream, tiebreak, t, share.alias("pct"))
    )


def sample_first(
    df: DataFrame,
    drain: int = 0,
    stream: str = "stream_id",
    t: str = "t",
    tiebreak: str = "frame_id",
) -> DataFrame:
    """The first frame of each stream, and ``drain`` more that were under way.

    The rank filter is applied by each task before the shuffle as well, so a
    stream contributes at most ``1 + drain`` rows per task.
    """
    order = Window.partitionBy(stream).orderBy(t, tiebreak)
    return (
        df.select(stream, tiebreak, t)
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= 1 + drain)
        .drop("_rank")
    )


def sample_at_time(
    df: DataFrame,
    seconds: int,
    drain: int = 0,
    stream: str = "stream_id",
    t: str = "t",
    tiebreak: str = "frame_id",
) -> DataFrame:
    """The first frame of each stream at or after ``seconds``."""
    if seconds < 0:
        raise ValueError("time_second must be non-negative.")
    return sample_first(df.filter(F.col(t) >= seconds), drain, stream, t, tiebreak)


def sample_at_times(
    frames: DataFrame, requests: DataFrame, cell_seconds: int = DEFAULT_CELL_SECONDS
) -> DataFrame:
    """For each requested (stream_id, at) the first frame at or after it, if there is one.

    Requests and frames are sorted together inside a cell; a request with no
    later frame in its cell takes the first frame of the next cell that has any.
    """
    frame = F.struct("frame_id", "t")
    moments = (
        frames.select("stream_id", F.col("t").alias("_at"), F.lit(1).alias("_kind"), frame.alias("_frame"))
        .unionByName(
            requests.select(
                "stream_id",
                F.col("at").cast("double").alias("_at"),
                F.lit(0).alias("_kind"),
                F.lit(None).cast(frames.select(frame).schema[0].dataType).alias("_frame"),
            )
        )
    )
    ahead = carry(
        with_cell(moments, "_at", cell_seconds),
        ["stream_id"],
        [F.min(F.when(F.col("_kind") == 1, F.struct("_at", "_frame"))).alias("_head")],
        lambda w: [F.last("_head._frame", ignorenulls=True).over(w.after).alias("_later")],
    )
    # From the end backwards: the nearest later frame is the last one met.
    backwards = in_cell(
        ["stream_id"], F.desc("_at"), F.desc("_kind"), F.desc("_frame.frame_id")
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.last("_frame", ignorenulls=True).over(backwards)
    found = ahead.withColumn("_found", F.coalesce(here, F.col("_later")))
    at = requests.schema["at"].dataType
    return found.filter((F.col("_kind") == 0) & F.col("_found").isNotNull()).select(
        "stream_id", F.col("_at").cast(at).alias("at"), "_found.frame_id", "_found.t"
    )


_SAMPLERS: dict[str, Callable[..., DataFrame]] = {
    "interval": sample_interval,
    "percentage": sample_percentage,
    "immediate": sample_first,
    "specific_time": sample_at_time,
}


def register_sampler(name: str, fn: Callable[..., DataFrame]) -> None:
    """Add a sampler: a function from a DataFrame of frames to one of kept frames."""
    _SAMPLERS[name] = fn


def sample(df: DataFrame, method: str, **params) -> DataFrame:
    if method not in _SAMPLERS:
        raise ValueError("Invalid screenshot method.")
    return _SAMPLERS[method](df, **params)


def saved_counts(kept: DataFrame) -> DataFrame:
    """Frames kept per stream, and per method where the rows carry one."""
    keys = [k for k in ("stream_id", "method") if k in kept.columns]
    return kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
