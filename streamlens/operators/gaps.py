"""Sessions by inactivity: a gap longer than the limit ends a stream."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from streamlens.operators.cells import (
    CELL,
    DEFAULT_CELL_SECONDS,
    CellWindows,
    carry,
    clock,
    clock_of,
    in_cell,
    ticks_in,
    with_cell_width,
)

# Fixed value: seconds without a packet after which an input counts as dead.
READ_TIMEOUT_SECONDS = 3


def gap_sessions(
    df: DataFrame,
    gap: float = READ_TIMEOUT_SECONDS,
    time: str = "ts",
    cell_seconds: int = DEFAULT_CELL_SECONDS,
    tb: tuple[int, int] | None = None,
) -> DataFrame:
    """Runs of rows no more than ``gap`` seconds apart, numbered from 0 per stream.

    A ``time`` that counts ticks needs their time base ``tb``.

    Runs are formed inside cells. The last run of a cell and the first run of the
    next are the same session if the rows across the border are close enough; the
    cell summaries decide that and give each cell the number its runs start at.
    """
    limit = ticks_in(df, time, gap, tb)
    kind = df.schema[time].dataType

    def apart(later: Column, earlier: Column) -> Column:
        if isinstance(kind, TimestampNTZType):
            return later - earlier > F.lit(timedelta(microseconds=limit))
        return clock_of(kind, later) - clock_of(kind, earlier) > limit

    order = in_cell(["stream_id"], time)
    # Only the time itself goes through the shuffle, so both uses of the runs share it.
    width = max(1, ticks_in(df, time, cell_seconds, tb))
    celled = with_cell_width(df.select("stream_id", time), time, width)
    marked = celled.withColumn("_before", F.lag(time).over(order))
    begins = F.coalesce(apart(F.col(time), F.col("_before")), F.lit(False)).cast("int")
    runs = (
        marked.withColumn("_begins", begins)
        .withColumn("_run", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("stream_id", CELL, "_run")
        .agg(
            F.min(time).alias("_start"),
            F.max(time).alias("_last"),
            F.count(F.lit(1)).alias("_n"),
        )
    )

    def numbering(w: CellWindows) -> list[Column]:
        # One less where the first run carries on the session of the cell before.
        joins = ~apart(F.col("_first"), F.lag("_final").over(w.order))
        new = F.col("_runs") - F.coalesce(joins, F.lit(False)).cast("int")
        return [F.sum(new).over(w.up_to).alias("_upto"), F.col("_runs")]

    numbered = carry(
        runs,
        ["stream_id"],
        [
            F.min("_start").alias("_first"),
            F.max("_last").alias("_final"),
            F.count(F.lit(1)).alias("_runs"),
        ],
        numbering,
    ).withColumn("session_no", (F.col("_upto") - F.col("_runs") + F.col("_run")).cast("bigint"))
    return numbered.groupBy("stream_id", "session_no").agg(
        F.min("_start").alias("start_ts"),
        F.max("_last").alias("last_ts"),
        F.sum("_n").cast("bigint").alias("n"),
    )


def until_timeout(
    df: DataFrame,
    gap: float = READ_TIMEOUT_SECONDS,
    time: str = "ts",
    cell_seconds: int = DEFAULT_CELL_SECONDS,
    tb: tuple[int, int] | None = None,
) -> DataFrame:
    """The rows of each stream before its first gap longer than ``gap`` seconds.

    A ``time`` that counts ticks needs their time base ``tb``.
    """
    limit = ticks_in(df, time, gap, tb)
    ticks = df.withColumn("_tick", clock(df, time))
    ticked = with_cell_width(ticks, "_tick", max(1, ticks_in(df, time, cell_seconds, tb)))
    before = F.lag("_tick").over(in_cell(["stream_id"], "_tick"))
    summary = (
        ticked.select("stream_id", CELL, "_tick")
        .withColumn("_before", before)
        .groupBy("stream_id", CELL)
        .agg(
            F.min("_tick").alias("_first"),
            F.max("_tick").alias("_final"),
            F.min(F.when(F.col("_tick") - F.col("_before") > limit, F.col("_tick"))).alias("_inner"),
        )
    )
    w = CellWindows.over(["stream_id"])
    late = F.col("_first") - F.lag("_final").over(w.order) > limit
    here = F.when(late, F.col("_first")).otherwise(F.col("_inner"))
    # A cell is cut by its own gaps and by those of any cell before it.
    cuts = summary.withColumn("_here", here).select(
        "stream_id", CELL, F.min("_here").over(w.up_to).alias("_cut")
    )
    return (
        ticked.join(cuts, ["stream_id", CELL])
        .filter(F.col("_cut").isNull() | (F.col("_tick") < F.col("_cut")))
        .select(*df.columns)
    )
