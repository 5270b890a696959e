"""Start, stop and update commands: their outcome, sessions and packets inside them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamlens.operators.cells import (
    CELL,
    DEFAULT_CELL_SECONDS,
    carry,
    in_cell,
    with_cell,
)

STARTED, RUNNING = "started", "already_running"
STOPPED, NOT_RUNNING = "stopped", "not_running"
UPDATED, NOT_FOUND = "updated", "not_found"


def with_task_state(
    commands: DataFrame, keys: Sequence[str], time: str, tiebreak: str, cell_seconds: int
) -> DataFrame:
    """Add ``_active``: whether the task runs just before the command.

    A refused command leaves the state as it was, so the state is that of the
    last start or stop command before, whether it was accepted or not.
    """
    switch = F.when(F.col("action") != "update", F.col("action"))
    order = F.struct(time, tiebreak)
    carried = carry(
        with_cell(commands, time, cell_seconds),
        keys,
        [
            F.max_by("action", F.when(F.col("action") != "update", order)).alias("_end"),
            F.min(F.when(F.col("action") == "stop", F.struct(time, tiebreak))).alias("_stop"),
        ],
        lambda w: [
            F.last("_end", ignorenulls=True).over(w.before).alias("_entry"),
            F.last("_stop", ignorenulls=True).over(w.after).alias("_later_stop"),
        ],
    )
    so_far = F.last(switch, ignorenulls=True).over(
        in_cell(keys, time, tiebreak).rowsBetween(Window.unboundedPreceding, -1)
    )
    state = F.coalesce(so_far, F.col("_entry"))
    return carried.withColumn("_active", F.coalesce(state == "start", F.lit(False)))


def outcome() -> Column:
    """What becomes of a command, from its action and ``_active``."""
    active = F.col("_active")
    return (
        F.when(F.col("action") == "start", F.when(active, RUNNING).otherwise(STARTED))
        .when(F.col("action") == "stop", F.when(active, STOPPED).otherwise(NOT_RUNNING))
        .when(F.col("action") == "update", F.when(active, UPDATED).otherwise(NOT_FOUND))
    )


def command_outcome(
    commands: DataFrame,
    keys: Sequence[str] = ("stream_id",),
    time: str = "ts",
    tiebreak: str = "event_id",
    cell_seconds: int = DEFAULT_CELL_SECONDS,
) -> DataFrame:
    """Whether each command is accepted, given the ones before it on the same task key.

    A task ends only by a stop command; pass the end of a stream as one to model
    inputs that run out.
    """
    judged = with_task_state(commands, keys, time, tiebreak, cell_seconds)
    return judged.select(*keys, tiebreak, "action", outcome().alias("outcome"))


def sessions_from_commands(
    commands: DataFrame,
    keys: Sequence[str] = ("stream_id",),
    time: str = "ts",
    tiebreak: str = "event_id",
    cell_seconds: int = DEFAULT_CELL_SECONDS,
) -> DataFrame:
    """Accepted starts with the time of the next stop, NULL while still running.

    Accepted starts and stops take turns, and after the last start of a cell the
    first stop of a later one is the accepted one.
    """
    switches = commands.filter(F.col("action").isin("start", "stop"))
    judged = with_task_state(switches, keys, time, tiebreak, cell_seconds)
    start, active = F.col("action") == "start", F.col("_active")
    accepted = judged.filter(start != active)
    in_this_cell = F.lead(time).over(in_cell(keys, time, tiebreak))
    return (
        accepted.withColumn("stop_ts", F.coalesce(in_this_cell, F.col(f"_later_stop.{time}")))
        .filter(F.col("action") == "start")
        .select(*keys, F.col(tiebreak).alias("session_id"), F.col(time).alias("start_ts"), "stop_ts")
    )


def record_sessions(
    frames: DataFrame,
    sessions: DataFrame,
    keep: Sequence[str] = (),
    cell_seconds: int = DEFAULT_CELL_SECONDS,
    keep_cells: bool = False,
    methods: Sequence[str] | None = None,
) -> DataFrame:
    """Frames inside a ``[start_ts, stop_ts)`` session of their stream, with columns ``keep``.

    Sessions of one task key do not overlap, so a frame can only belong to the
    last one started at or before it: an as-of lookup, with no range join and no
    copies of frames. With ``methods`` the sessions carry a ``method``, which belongs to
    their task key: the last session of each method is looked up in the same pass, and a frame is
    given once, with its ``method``, for each session it is in. Sessions of other methods
    are left out. Sessions may overlap only if their methods differ.
    """
    session = F.struct("session_id", "stop_ts")
    none = F.lit(None).cast(sessions.select(session).schema[0].dataType)
    method = F.col("method") if methods is not None else F.lit(None).cast("string")
    starts = sessions.select(
        "stream_id",
        F.col("start_ts").alias("ts"),
        F.lit(0).alias("_kind"),
        F.col("session_id").alias("_order"),
        session.alias("_session"),
        method.alias("_method"),
    )
    packets = frames.select(
        "stream_id",
        "ts",
        F.lit(1).alias("_kind"),
        F.col("frame_id").alias("_order"),
        none.alias("_session"),
        F.lit(None).cast("string").alias("_method"),
        "frame_id",
        *keep,
    )
    lanes = [None] if methods is None else list(dict.fromkeys(methods))

    def begins(lane: str | None) -> Column:
        return (F.col("_kind") == 0) & (F.lit(True) if lane is None else F.col("_method") == lane)

    events = packets.unionByName(starts, allowMissingColumns=True)
    carried = carry(
        with_cell(events, "ts", cell_seconds),
        ["stream_id"],
        [
            F.max(F.when(begins(lane), F.struct("ts", "_order", "_session"))).alias(f"_tail{i}")
            for i, lane in enumerate(lanes)
        ],
        lambda w: [
            F.last(f"_tail{i}._session", ignorenulls=True).over(w.before).alias(f"_open{i}")
            for i in range(len(lanes))
        ],
    )
    so_far = in_cell(["stream_id"], "ts", "_kind", "_order").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    current = carried.withColumns(
        {
            f"_in{i}": F.coalesce(
                F.last(F.when(begins(lane), F.col("_session")), ignorenulls=True).over(so_far),
                F.col(f"_open{i}"),
            )
            for i, lane in enumerate(lanes)
        }
    ).filter(F.col("_kind") == 1)

    def inside(found: Column) -> Column:
        stop = found["stop_ts"]
        return found["session_id"].isNotNull() & (stop.isNull() | (F.col("ts") < stop))

    cell = [CELL] if keep_cells else []
    if methods is None:
        return current.filter(inside(F.col("_in0"))).select(
            "stream_id", "_in0.session_id", "frame_id", "ts", *keep, *cell
        )
    found = F.array(
        *[
            F.struct(F.lit(lane).alias("method"), F.col(f"_in{i}").alias("of"))
            for i, lane in enumerate(lanes)
        ]
    )
    return current.withColumn(
        "_in", F.explode(F.filter(found, lambda x: inside(x["of"])))
    ).select("stream_id", "_in.method", "_in.of.session_id", "frame_id", "ts", *keep, *cell)


def active_task_profile(
    sessions: DataFrame, max_tasks: int = 3, cell_seconds: int = DEFAULT_CELL_SECONDS
) -> DataFrame:
    """Number of running tasks after each change, against the limit of concurrent ones.

    The running total has no key to spread it by. Changes are first added up per
    instant, then per cell; only the cell totals, one row each, are summed in
    one sequence, and the rest happens inside cells.
    """
    edge = F.explode(
        F.array(
            F.struct(F.col("start_ts").alias("ts"), F.lit(1).alias("delta")),
            F.struct(F.col("stop_ts").alias("ts"), F.lit(-1).alias("delta")),
        )
    ).alias("_edge")
    changes = (
        sessions.select(edge)
        .select("_edge.*")
        .filter(F.col("ts").isNotNull())
        .groupBy("ts")
        .agg(F.sum("delta").alias("_delta"))
    )
    carried = carry(
        with_cell(changes, "ts", cell_seconds),
        [],
        [F.sum("_delta").alias("_sum")],
        lambda w: [F.coalesce(F.sum("_sum").over(w.before), F.lit(0)).alias("_base")],
    )
    here = F.sum("_delta").over(
        Window.partitionBy(CELL).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    )
    active = (F.col("_base") + here).cast("bigint")
    return carried.select("ts", active.alias("active")).withColumn(
        "over_limit", F.col("active") > max_tasks
    )
