"""Rows of a live stream in event-time order, however they fall into micro-batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Microseconds since 1970 of each input row, beside the event time that carries the watermark.
#: The engine renames columns that begin with an underscore.
MICROS_COLUMN = "micros_"


#: The group of keys whose rows a task handles at once; it is what state is kept by.
GROUP_COLUMN = "group_"
#: Marks a column that tells where a whole number was null; the number itself is 0 there.
NULLS = "_null_"
#: Columns that each key's state begins with, after the key.
LAST = "last_"


def packed(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(raw: bytes) -> pd.DataFrame:
    table = pa.ipc.open_stream(raw).read_all()
    rows = table.to_pandas()
    for name in table.column_names:
        # whole numbers stay whole beside nulls
        if pa.types.is_integer(table.schema.field(name).type) and table[name].null_count:
            rows[name] = pd.array(table[name].to_pylist(), dtype="Int64")
    return rows


def with_nulls(rows: pd.DataFrame) -> pd.DataFrame:
    """Whole numbers with the nulls that came beside them, which pandas would make doubles."""
    for flag in [c for c in rows.columns if c.endswith(NULLS)]:
        lost, name = rows.pop(flag).to_numpy().astype(bool), flag.removesuffix(NULLS)
        if lost.any():
            rows[name] = pd.arrays.IntegerArray(rows[name].to_numpy().astype(np.int64), lost)
    return rows


def plain(value: Any) -> Any:
    """A value of the state store without its rows, which cannot be stored again as they are."""
    if isinstance(value, tuple):
        return tuple(plain(v) for v in value)
    return [plain(v) for v in value] if isinstance(value, list) else value


class Runs(NamedTuple):
    """Stretches of sorted rows, one key's each.

    ``before`` is each key's state, None where it has none. Run ``k`` lies between ``bounds[k]`` and
    ``bounds[k + 1]``; after one that is ``ended`` the same key begins anew in the next run.
    """

    keys: list
    before: list[tuple | None]
    bounds: np.ndarray
    ended: np.ndarray

    @property
    def of_rows(self) -> np.ndarray:
        """The run of each row."""
        return np.repeat(np.arange(len(self.keys)), np.diff(self.bounds))


class OrderedProcessor(StatefulProcessor):
    """Hands the rows of a group of keys to ``step`` in order, once nothing earlier can come.

    Keys are dealt to groups, so that calls and entries of state are as many as groups and buckets, however many
    keys there are. Rows wait in a map by bucket of event time and batch. A timer at each bucket's end
    releases it when the watermark gets there; later rows of the bucket are then late and dropped by the engine. A
    batch adds one entry to a bucket and never rewrites others, and a group's bucket is all that is sorted at
    a time. What is kept of each key is one element of a list.

    With ``idle_ms`` a key is over when none of its rows comes for that long in event time: ``finish``
    gives what is still to be said, and all of the key's state goes. That happens between two
    rows as far apart as well, so results do not depend on when the rows come.
    """

    #: The column that names the key.
    key = "stream_id"
    #: Columns that order a key's rows, after their event time.
    order: tuple[str, ...] = ()
    #: The name of the list of states, and what ``step`` keeps of a key.
    state_name, columns_kept = "states", ""

    def __init__(self, bucket_ms: int, idle_ms: int | None = None):
        if bucket_ms <= 0 or idle_ms is not None and idle_ms <= 0:
            raise ValueError("Buckets and idle times must be positive.")
        self.bucket_ms, self.idle_ms = bucket_ms, idle_ms
        self.key_type = "long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long, part long", "rows binary")
        #: How many entries were made.
        self.place = handle.getValueState("place", "parts long")
        #: The event time of the last row released of each key, and what ``step`` keeps.
        schema = f"{self.key} {self.key_type}, {LAST} long, {self.columns_kept}"
        self.stored = handle.getListState(self.state_name, schema)
        #: Groups whose rows are released, and up to where; timers of different groups alternate.
        self.done: dict[Any, int] = {}
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Make further state that ``step`` needs."""

    def wanted(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The rows that are worth keeping until their turn comes."""
        return rows

    def begin(self) -> None:
        """Called before a group's rows are released."""

    def settle(self) -> None:
        """Called when a group's rows were released."""

    def step(self, runs: Runs, rows: pd.DataFrame) -> tuple[list[tuple], list[pd.DataFrame]]:
        """The state after each run, and rows to give out."""
        raise NotImplementedError

    def finish(self, over: list[tuple[Any, tuple]]) -> list[pd.DataFrame]:
        """What is still to be said of keys that are over, by their states."""
        return []

    def load(self) -> dict[Any, tuple]:
        return {s[0]: plain(s[1:]) for s in self.stored.get()} if self.stored.exists() else {}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = parts = self.place.get()[0] if self.place.exists() else 0
        for frame in rows:
            # the engine hands over a frame without columns where a group has only timers
            frame = frame if frame.empty else self.wanted(with_nulls(frame))
            if frame.empty:
                continue
            buckets = frame[MICROS_COLUMN].to_numpy() // (1000 * self.bucket_ms)
            for bucket in np.unique(buckets).tolist():
                self.waiting.updateValue((bucket, parts), (packed(frame[buckets == bucket]),))
                self.handle.registerTimer((bucket + 1) * self.bucket_ms)
                parts += 1
        if parts > first:
            self.place.update((parts,))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # all that the watermark has passed is here, also what this timer is not for
        now = timerValues.getCurrentWatermarkInMs()
        if self.done.get(key) == now:
            return
        self.done[key] = now
        due: dict[int, list[tuple[int, int]]] = {}
        later = []
        for bucket, part in list(self.waiting.keys()):
            if (bucket + 1) * self.bucket_ms <= now:
                due.setdefault(bucket, []).append((bucket, part))
            else:
                later.append(bucket)
        if not due and self.idle_ms is None:
            return
        self.states = self.load()
        self.begin()
        for bucket in sorted(due):
            frames = [unpacked(self.waiting.getValue(entry)[0]) for entry in due[bucket]]
            rows = pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0]
            yield from self._released(rows.sort_values([self.key, MICROS_COLUMN, *self.order], ignore_index=True))
            for entry in due[bucket]:
                self.waiting.removeKey(entry)
        if self.idle_ms is not None:
            yield from self._idle(now, min(later, default=None))
        self.settle()
        if self.states:
            self.stored.put([(k, *s) for k, s in self.states.items()])
        else:
            self.stored.clear()
        if not later:
            self.place.clear()

    def _released(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        at, keys = rows[MICROS_COLUMN].to_numpy(), rows[self.key].to_numpy()
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        cuts = np.zeros(len(rows), dtype=bool)
        if self.idle_ms is not None:
            first, since = np.flatnonzero(new), np.diff(at, prepend=at[0])
            known = [self.states.get(k) for k in keys[first].tolist()]
            since[first] = [0 if s is None else a - s[0] for a, s in zip(at[first].tolist(), known, strict=True)]
            cuts = since > 1000 * self.idle_ms
        starts = np.flatnonzero(new | cuts)
        names, anew, firsts = keys[starts].tolist(), cuts[starts], new[starts].tolist()
        # a key that had been over for long when its first row here came
        gone = [names[k] for k in np.flatnonzero(anew & new[starts]).tolist()]
        yield from self.finish([(k, self.states.pop(k)[1:]) for k in gone])
        none = (None,)
        before = [self.states.get(k, none)[1:] or None if f else None for k, f in zip(names, firsts, strict=True)]
        ended = np.append(~new[starts][1:], False)
        after, out = self.step(Runs(names, before, np.append(starts, len(rows)), ended), rows)
        yield from out
        yield from self.finish([(names[k], after[k]) for k in np.flatnonzero(ended).tolist()])
        last = at[np.append(starts[1:], len(rows)) - 1].tolist()
        for k, moment, state in zip(names, last, after, strict=True):
            self.states[k] = (moment, *state)

    def _idle(self, now: int, waits: int | None) -> Iterator[pd.DataFrame]:
        """Finish the keys whose time is up; of the others the first to be over gets a timer."""
        idle = 1000 * self.idle_ms
        # rows that wait may still lie within the idle time
        limit = 1000 * now if waits is None else min(1000 * now, 1000 * waits * self.bucket_ms)
        over = [k for k, s in self.states.items() if s[0] + idle < limit]
        yield from self.finish([(k, self.states.pop(k)[1:]) for k in over])
        # a whole millisecond after the time is up, so that equal times are not over
        ends = [s[0] // 1000 + self.idle_ms + 2 for s in self.states.values()]
        if ahead := [end for end in ends if end > now]:
            self.handle.registerTimer(min(ahead))

    def close(self) -> None:
        pass
