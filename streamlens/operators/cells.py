"""Time cells: how per-stream operators avoid putting one stream into one task.

A stream may hold a large part of all rows, so no operator sorts or collects a
whole stream. Rows are grouped by ``(stream, cell)``, a cell being a fixed span
of the stream's clock. Row-level windows never leave a cell. What a cell needs
to know about the cells before or after it is computed on a summary with one
row per cell, which is small, partially aggregated before its shuffle, and
joined back on ``(stream, cell)``, the partitioning the row-level windows use.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamlens.checkpoints import fresh_path
from streamlens.functions.media import micros

CELL = "_cell"

DEFAULT_CELL_SECONDS = 3600
TARGET_CELL_ROWS = 2_000_000


def clock(df: DataFrame, name: str) -> Column:
    """A column as a BIGINT clock: microseconds, days or plain ticks by its type."""
    return clock_of(df.schema[name].dataType, F.col(name))


def clock_of(kind: T.DataType, value: Column) -> Column:
    if isinstance(kind, T.TimestampNTZType):
        return micros(value)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("bigint")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.floor(value * F.lit(1_000_000.0))
    return value.cast("bigint")


def ticks_per_second(df: DataFrame, name: str) -> int:
    """How many units of ``clock`` make a second, for time columns."""
    kind = df.schema[name].dataType
    micro = (T.TimestampNTZType, T.TimestampType, T.DoubleType, T.FloatType)
    return 1_000_000 if isinstance(kind, micro) else 1


def ticks_in(df: DataFrame, name: str, seconds: float, tb: tuple[int, int] | None) -> int:
    """How many whole units of a clock ``seconds`` hold; counted ticks need their time base."""
    if isinstance(df.schema[name].dataType, T.IntegralType):
        if tb is None:
            raise ValueError(f"{name} counts ticks: give their time base as tb.")
        return math.floor(Fraction(str(seconds)) * tb[1] / tb[0])
    return math.floor(Fraction(str(seconds)) * ticks_per_second(df, name))


def with_cell(df: DataFrame, time: str, seconds: int) -> DataFrame:
    width = seconds * ticks_per_second(df, time)
    return with_cell_width(df, time, width)


def with_cell_width(df: DataFrame, name: str, width: int) -> DataFrame:
    """Add the cell of each row, unless the rows carry one along.

    Rows that kept the cells of an earlier operator are still partitioned by them
    and need no further shuffle. Any clock that orders a stream in the same way
    makes the same use of them. Rows without a time are in no cell and left out,
    which is said here so that rows and summaries have one plan to share; ``unplaced``
    gives the rows that are left out and ``set_aside`` writes them, to be repaired or counted.
    """
    if CELL in df.columns:
        return df
    cell = F.call_function("div", clock(df, name), F.lit(width))
    return df.withColumn(CELL, cell).filter(F.col(CELL).isNotNull())


def unplaced(df: DataFrame, stream: str = "stream_id", time: str = "ts") -> DataFrame:
    """The rows without a stream or a time, which no order has a place for."""
    return df.filter(F.col(stream).isNull() | F.col(time).isNull())


def set_aside(
    df: DataFrame, path: str | None, stream: str = "stream_id", time: str = "ts"
) -> DataFrame:
    """The rows that have a place, once those that have none are written to ``path``.

    Without a path such rows are an error, which names how many there are. Files that keep counts of
    nulls answer that without being read.
    """
    lost = unplaced(df, stream, time)
    if path is not None:
        lost.write.parquet(path)
    elif n := lost.count():
        raise ValueError(f"{n} rows have no {stream} or {time}; name a folder to set them aside.")
    return df.filter(F.col(stream).isNotNull() & F.col(time).isNotNull())


def measure_cell_seconds(
    df: DataFrame,
    stream: str | None = "stream_id",
    time: str = "ts",
    target_rows: int = TARGET_CELL_ROWS,
) -> int:
    """Widest cell, in seconds, that no stream fills with more than ``target_rows``.

    Without ``stream`` all rows share one clock, as for ``active_task_profile``.

    Counts rows per stream and hour (then minute, then second, where an hour or
    minute alone is too full). Counts are combined before the shuffle and only
    the largest one reaches the driver.
    """
    keys = [stream] if stream else []
    for span in (3600, 60, 1):
        fullest = (
            with_cell(df.select(*keys, time).dropna(), time, span)
            .groupBy(*keys, CELL)
            .count()
            .agg(F.max("count").alias("n"))
            .first()["n"]
        )
        if not fullest:
            return DEFAULT_CELL_SECONDS
        if fullest <= target_rows or span == 1:
            return span * max(1, target_rows // fullest)
    raise AssertionError("unreachable")


@dataclass(frozen=True)
class CellWindows:
    """Windows over the cell summaries of a stream.

    ``after`` runs backwards from the end, so that the nearest later cell comes
    last: a frame that reaches forward to the end is computed anew for each row,
    which takes quadratic time, while one that starts at the beginning is not.
    """

    order: WindowSpec
    before: WindowSpec
    up_to: WindowSpec
    after: WindowSpec
    whole: WindowSpec

    @classmethod
    def over(cls, keys: Sequence[str]) -> CellWindows:
        stream = Window.partitionBy(*keys)
        order = stream.orderBy(CELL)
        first, last = Window.unboundedPreceding, Window.unboundedFollowing
        return cls(
            order=order,
            before=order.rowsBetween(first, -1),
            up_to=order.rowsBetween(first, 0),
            after=stream.orderBy(F.desc(CELL)).rowsBetween(first, -1),
            whole=stream.rowsBetween(first, last),
        )


def carry(
    rows: DataFrame,
    keys: Sequence[str],
    per_cell: Sequence[Column],
    across: Callable[[CellWindows], Sequence[Column]],
    summarised: DataFrame | None = None,
) -> DataFrame:
    """Attach to each row what ``across`` computes over its stream's cell summaries.

    The summary is of ``rows``, or of ``summarised``: the same rows before joins
    it does not need. Rows without a key are left out. Every other row meets exactly one
    summary, so the join is an outer one, which Spark drops where nothing carried is used.
    """
    rows = _keyed(rows, keys)
    source = rows if summarised is None else _keyed(summarised, keys)
    summary = source.groupBy(*keys, CELL).agg(*per_cell)
    carried = summary.select(*keys, CELL, *across(CellWindows.over(keys)))
    return rows.join(carried, [*keys, CELL], "left")


def _keyed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    for key in keys:
        rows = rows.filter(F.col(key).isNotNull())
    return rows


def kept_by_cell(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Write rows that are partitioned by their cells once, in buckets of key and cell, to be read again.

    For rows that are dear to make and that several summaries are taken of: each of those then reads a few
    columns of the table, and neither its rows nor theirs are shuffled again. The table lies in the
    shared folder, so lost executors read it anew.
    """
    spark = rows.sparkSession
    path = fresh_path(spark, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = rows.write.bucketBy(buckets, *keys, CELL).sortBy(*keys, CELL)
    writer.option("path", path).saveAsTable(table, format="parquet")
    return spark.table(table)


def in_cell(keys: Sequence[str], *order: str | Column) -> WindowSpec:
    return Window.partitionBy(*keys, CELL).orderBy(*order)


def number_rows(
    df: DataFrame,
    name: str,
    order: Sequence[str],
    width: int,
    keys: Sequence[str] = ("stream_id",),
) -> DataFrame:
    """Number the rows of each stream from 0 in ``order``, whose first column is a clock.

    ``width`` is that of a cell, in units of the clock.
    """
    offset = carry(
        with_cell_width(df, order[0], width),
        keys,
        [F.count(F.lit(1)).alias("_n")],
        lambda w: [F.coalesce(F.sum("_n").over(w.before), F.lit(0)).alias("_offset")],
    )
    local = F.row_number().over(in_cell(keys, *order)) - 1
    return offset.withColumn(name, (F.col("_offset") + local).cast("bigint")).select(
        *df.columns, name
    )
