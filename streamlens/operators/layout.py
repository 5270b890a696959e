"""Layouts of a mix: comparing full stream lists, replaying them, ordering and timing inputs."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamlens.functions.media import MICROS, is_live
from streamlens.operators.cells import (
    CELL,
    carry,
    in_cell,
    with_cell_width,
)

# What a stream entry must have, and what of it counts as a change.
STREAM_FIELDS = ("id", "url", "width", "height", "x", "y", "z-index")
GEOMETRY = ("width", "height", "x", "y", "z")

CELL_VERSIONS = 4096
CELL_TICKS = 10_000


def streams_schema() -> str:
    return "array<struct<" + ",".join(f"`{f}`:string" for f in STREAM_FIELDS) + ">>"


def valid_streams(streams: Column) -> Column:
    """The entries of a parsed list that have every field and a live URL."""
    def whole(s: Column) -> Column:
        checks = [s.getField(f).isNotNull() for f in STREAM_FIELDS]
        checks.append(is_live(s.getField("url")))
        out = checks[0]
        for c in checks[1:]:
            out = out & c
        return out

    return F.filter(streams, whole)


def explode_streams(df: DataFrame, streams_json: str = "streams") -> DataFrame:
    """One row per valid entry of a JSON list of streams; other entries are dropped."""
    parsed = F.from_json(F.col(streams_json), streams_schema())
    rest = [c for c in df.columns if c != streams_json]
    one = df.select(*rest, F.posexplode(valid_streams(parsed)).alias("pos", "_s"))

    def number(field: str) -> Column:
        return F.col("_s").getField(field).try_cast("int")

    return one.select(
        *rest,
        "pos",
        F.col("_s.id").alias("id"),
        F.col("_s.url").alias("url"),
        *[number(f).alias(f) for f in GEOMETRY[:-1]],
        number("z-index").alias("z"),
    )


def last_of_duplicates(layout: DataFrame) -> DataFrame:
    """One row per id and version: of entries with the same id, the last in the list."""
    rest = [c for c in layout.columns if c not in ("task_id", "ver", "id", "pos")]
    return (
        layout.groupBy("task_id", "ver", "id")
        .agg(F.max_by(F.struct(*rest), "pos").alias("_s"))
        .select("task_id", "ver", "id", "_s.*")
    )


def _versions(layout: DataFrame, cell_versions: int) -> DataFrame:
    """The versions of each task with the ones before and after them."""
    celled = with_cell_width(layout.select("task_id", "ver"), "ver", cell_versions)
    carried = carry(
        celled.distinct(),
        ["task_id"],
        [F.min("ver").alias("_min"), F.max("ver").alias("_max")],
        lambda w: [
            F.max("_max").over(w.before).alias("_earlier"),
            F.min("_min").over(w.after).alias("_later"),
        ],
        summarised=celled,
    )
    here = in_cell(["task_id"], "ver")
    return carried.select(
        "task_id",
        "ver",
        F.coalesce(F.lag("ver").over(here), F.col("_earlier")).alias("_prev"),
        F.coalesce(F.lead("ver").over(here), F.col("_later")).alias("_next"),
    )


def _beside(layout: DataFrame, cell_versions: int) -> DataFrame:
    """Each entry beside the same id's one before (``_old``) and the version it is next in.

    ``_prev`` and ``_next`` are the task's versions around it: an id that was gone
    in between has an ``_old`` of some other version.
    """
    keys = ["task_id", "id"]
    entry = F.struct("ver", *GEOMETRY)
    celled = with_cell_width(layout, "ver", cell_versions)
    carried = carry(
        celled.join(_versions(layout, cell_versions), ["task_id", "ver"]),
        keys,
        [F.max(entry).alias("_last"), F.min("ver").alias("_first")],
        lambda w: [
            F.last("_last").over(w.before).alias("_earlier"),
            F.last("_first").over(w.after).alias("_later"),
        ],
        summarised=celled,
    )
    here = in_cell(keys, "ver")
    return carried.withColumns(
        {
            "_old": F.coalesce(F.lag(entry).over(here), F.col("_earlier")),
            "_again": F.coalesce(F.lead("ver").over(here), F.col("_later")),
        }
    )


def _is_new() -> Column:
    return F.col("_old").isNull() | ~F.col("_old.ver").eqNullSafe(F.col("_prev"))


def _changed() -> Column:
    same = F.lit(True)
    for g in GEOMETRY:
        same = same & F.col(f"_old.{g}").eqNullSafe(F.col(g))
    return ~same


def layout_diff(layout: DataFrame, cell_versions: int = CELL_VERSIONS) -> DataFrame:
    """What each version of a task changes against the one before it.

    A stream whose URL alone differs counts as unchanged. The first version of a
    task has nothing to be compared with and is left out.
    """
    change = F.when(_is_new(), "added").when(_changed(), "updated").otherwise("unchanged")
    here = F.when(
        F.col("_prev").isNotNull(), F.struct("ver", change.alias("change"))
    )
    gone = F.when(
        F.col("_next").isNotNull() & ~F.col("_again").eqNullSafe(F.col("_next")),
        F.struct(F.col("_next").alias("ver"), F.lit("removed").alias("change")),
    )
    return (
        _beside(layout, cell_versions)
        .select("task_id", "id", F.explode(F.array_compact(F.array(here, gone))).alias("_c"))
        .select("task_id", "_c.ver", "id", "_c.change")
    )


def layout_replay(layout: DataFrame, cell_versions: int = CELL_VERSIONS) -> DataFrame:
    """The layout in force after each version has been applied to the one before.

    An entry is taken over when its id is new or its geometry differs; otherwise
    the running one stays, so its URL is the one of the last taking over.
    """
    keys = ["task_id", "id"]
    marked = _beside(layout, cell_versions).select(
        *keys,
        "ver",
        CELL,
        *GEOMETRY,
        F.when(_is_new() | _changed(), F.struct("url")).alias("_taken"),
    )
    carried = carry(
        marked,
        keys,
        [F.max_by("_taken", F.when(F.col("_taken").isNotNull(), F.col("ver"))).alias("_end")],
        lambda w: [F.last("_end", ignorenulls=True).over(w.before).alias("_entry")],
    )
    so_far = F.last("_taken", ignorenulls=True).over(
        in_cell(keys, "ver").rowsBetween(Window.unboundedPreceding, 0)
    )
    source = F.coalesce(so_far, F.col("_entry"))
    return carried.select(
        "task_id", "ver", "id", source.getField("url").alias("url_effective"), *GEOMETRY
    )


def paint_order(layout: DataFrame) -> DataFrame:
    """Layer of each entry of a version, from the lowest z upwards; equal z by id."""
    layer = F.row_number().over(Window.partitionBy("task_id", "ver").orderBy("z", "id")) - 1
    return layout.select("task_id", "ver", "id", "z", layer.cast("bigint").alias("layer"))


def first_tick(pts: Column | str, tb: tuple[int, int], step: tuple[int, int]) -> Column:
    """Number of the first tick of ``step`` seconds not before ``pts`` ticks of ``tb``; exact."""
    up, down = tb[0] * step[1], tb[1] * step[0]
    whole = F.col(pts) if isinstance(pts, str) else pts
    number = whole.cast("decimal(20,0)") * F.lit(Decimal(up))
    # div cuts towards zero; nothing is before tick 0
    above = F.call_function("div", number + F.lit(Decimal(down - 1)), F.lit(Decimal(down)))
    return F.greatest(above, F.lit(0)).cast("bigint")


def mix_on_clock(
    frames: DataFrame,
    step: tuple[int, int],
    until: tuple[int, int] | None = None,
    tb: tuple[int, int] = MICROS,
    cell_ticks: int = CELL_TICKS,
) -> DataFrame:
    """The frame each input shows at the output ticks 0, step, 2*step, ...

    ``step`` and ``until`` are fractions of a second, so (1, 25) is an exact clock; frames count
    ``pts`` in ticks of ``tb``. An input shows its latest frame not after the tick, and nothing
    before its first. It ends with the first tick not before its last frame; given ``until``, all
    inputs hold their last frame up to the last tick not after it. Only the last frame before a
    tick can be shown at it, so frames are first cut down to one per tick and input; each
    then fills the ticks up to the next one.
    """
    keys = ["stream_id", "media"]
    numbered = frames.withColumn("tick_no", first_tick("pts", tb, step))
    end = F.col("tick_no") + 1
    if until is not None:
        last_tick = until[0] * step[1] // (until[1] * step[0])
        numbered = numbered.filter(F.col("tick_no") <= last_tick)
        end = F.lit(last_tick + 1)
    shown = (
        numbered.groupBy(*keys, "tick_no")
        .agg(F.max(F.struct("pts", "frame_id")).alias("_f"))
        .select(*keys, "tick_no", "_f.frame_id")
    )
    carried = carry(
        with_cell_width(shown, "tick_no", cell_ticks),
        keys,
        [F.min("tick_no").alias("_head")],
        lambda w: [F.min("_head").over(w.after).alias("_later")],
    )
    following = F.coalesce(
        F.lead("tick_no").over(in_cell(keys, "tick_no")), F.col("_later"), end
    )
    # A frame may stand for long; it fills one cell of ticks at a time.
    width = F.lit(cell_ticks)
    until_cell = F.call_function("div", F.col("_next") - 1, width)
    stretches = carried.withColumn("_next", following).select(
        *keys,
        "tick_no",
        "frame_id",
        "_next",
        F.explode(F.sequence(F.col(CELL), until_cell)).alias("_in"),
    )
    first = F.greatest(F.col("tick_no"), F.col("_in") * width)
    last = F.least(F.col("_next"), (F.col("_in") + 1) * width) - 1
    filled = stretches.select(*keys, "frame_id", F.explode(F.sequence(first, last)).alias("tick_no"))
    tick = (F.col("tick_no") * F.lit(step[0])).cast("double") / F.lit(float(step[1]))
    return filled.select(*keys, tick.alias("tick"), "frame_id")
