"""State kept per stream, task or recording; rows come to ``step`` by key, in event-time order."""

from __future__ import annotations

import math
from bisect import bisect_left
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessorHandle

from streamlens.operators.control import (
    NOT_FOUND,
    NOT_RUNNING,
    RUNNING,
    STARTED,
    STOPPED,
    UPDATED,
)
from streamlens.operators.layout import GEOMETRY
from streamlens.operators.recording import OUT_INDEX
from streamlens.streaming.ordered import OrderedProcessor, Runs, packed, unpacked

# Fixed value: what becomes of a command, by action and whether the task runs.
OUTCOMES = {
    ("start", False): STARTED,
    ("start", True): RUNNING,
    ("stop", False): NOT_RUNNING,
    ("stop", True): STOPPED,
    ("update", False): NOT_FOUND,
    ("update", True): UPDATED,
}
#: The action of the row that ends a task whose input ran out.
ENDED = "end"
#: The state that tells whether a task runs.
TASK_STATE = "active"


def _before(runs: Runs, flags: np.ndarray, values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, and for each run's end, the value of the run's last flagged row before it, or its ``first``."""
    place = np.where(flags, np.arange(1, len(flags) + 1), 0)
    last = np.maximum.accumulate(np.concatenate(([0], place)))
    starts, run = runs.bounds[:-1], runs.of_rows
    rows, ends = last[:-1], last[runs.bounds[1:]]
    return (
        np.where(rows > starts[run], values[rows - 1], first[run]),
        np.where(ends > starts, values[ends - 1], first),
    )


def _whole(value: Any) -> int | None:
    """A whole number that came as a double where others beside it are null; the state store keeps no doubles for it."""
    return None if value is None or value != value else int(value)


class IntervalSampler(OrderedProcessor):
    """Remembers the whole second of the last kept frame."""

    order = ("t", "frame_id")
    columns_kept = "second long"

    def __init__(self, interval: int, bucket_ms: int, idle_ms: int | None = None):
        super().__init__(bucket_ms, idle_ms)
        self.interval = interval

    def step(self, runs: Runs, rows: pd.DataFrame) -> tuple[list[tuple], list[pd.DataFrame]]:
        t, bounds = rows["t"].to_numpy().tolist(), runs.bounds.tolist()
        kept, after = [], []
        for before, low, high in zip(runs.before, bounds, bounds[1:]):
            due = (before[0] if before else 0) + self.interval
            at = bisect_left(t, due, low, high)
            while at < high:
                kept.append(at)
                due = math.floor(t[at]) + self.interval
                at = bisect_left(t, due, at, high)
            after.append((due - self.interval,))
        return after, [rows.iloc[kept][["stream_id", "frame_id", "t"]]] if kept else []


class FirstSampler(OrderedProcessor):
    """Remembers how many frames were kept."""

    order = ("t", "frame_id")
    columns_kept = "kept long"

    def __init__(self, count: int, bucket_ms: int, idle_ms: int | None = None):
        super().__init__(bucket_ms, idle_ms)
        self.count = count

    def wanted(self, rows: pd.DataFrame) -> pd.DataFrame:
        if self.idle_ms is not None:
            return rows
        done = [k for k, s in self.load().items() if s[1] >= self.count]
        return rows[~rows["stream_id"].isin(done)] if done else rows

    def step(self, runs: Runs, rows: pd.DataFrame) -> tuple[list[tuple], list[pd.DataFrame]]:
        had = np.array([b[0] if b else 0 for b in runs.before])
        run = runs.of_rows
        kept = had[run] + np.arange(len(rows)) - runs.bounds[run] < self.count
        after = np.maximum(had, np.minimum(self.count, had + np.diff(runs.bounds)))
        out = rows[kept][["stream_id", "frame_id", "t"]]
        return [(n,) for n in after.tolist()], [out] if len(out) else []


class TaskState(OrderedProcessor):
    """Remembers whether the task runs; a task that still runs when its input ends is stopped."""

    order = ("event_id",)
    state_name, columns_kept = TASK_STATE, "active boolean"

    def step(self, runs: Runs, rows: pd.DataFrame) -> tuple[list[tuple], list[pd.DataFrame]]:
        actions = rows["action"].to_numpy()
        first = np.array([bool(b and b[0]) for b in runs.before])
        active, after = _before(runs, actions != "update", actions == "start", first)
        outcomes = [OUTCOMES[a, r] for a, r in zip(actions, active.tolist(), strict=True)]
        out = rows.assign(outcome=outcomes)[["stream_id", "event_id", "action", "outcome"]]
        return [(a,) for a in after.tolist()], [out]

    def finish(self, over: list[tuple[Any, tuple]]) -> list[pd.DataFrame]:
        names = [k for k, (active,) in over if active]
        if not names:
            return []
        none = [None] * len(names)
        return [pd.DataFrame({"stream_id": names, "event_id": none, "action": ENDED, "outcome": STOPPED})]


class LayoutState(OrderedProcessor):
    """Remembers the running streams of a mix; each input row is one full stream list.

    When its updates end, all that still runs is removed; such rows have no ``ver``.
    """

    key = "task_id"
    order = ("ver",)
    state_name = "layout"
    columns_kept = f"streams array<struct<id: string, url: string, {', '.join(f'{g}: int' for g in GEOMETRY)}>>"

    def step(self, runs: Runs, rows: pd.DataFrame) -> tuple[list[tuple], list[pd.DataFrame]]:
        vers, lists, bounds = rows["ver"].tolist(), rows["streams"].tolist(), runs.bounds.tolist()
        out, after = [], []
        for key, before, low, high in zip(runs.keys, runs.before, bounds, bounds[1:]):
            first = before is None
            active = {} if first else {s[0]: tuple(s) for s in before[0]}
            for ver, streams in zip(vers[low:high], lists[low:high]):
                # Of entries with the same id the last one counts.
                new = {s["id"]: (s["id"], s["url"], *(_whole(s[g]) for g in GEOMETRY)) for s in streams}
                changes = {gone: "removed" for gone in active.keys() - new.keys()}
                for name, entry in new.items():
                    if name not in active:
                        changes[name] = "added"
                    elif active[name][2:] != entry[2:]:
                        changes[name] = "updated"
                    else:
                        changes[name] = "unchanged"
                active = {n: active[n] if changes[n] == "unchanged" else e for n, e in new.items()}
                if not first:
                    out += [(key, ver, name, change) for name, change in changes.items()]
                first = False
            after.append((list(active.values()),))
        return after, self._changes(out)

    def _changes(self, out: list[tuple]) -> list[pd.DataFrame]:
        return [pd.DataFrame(out, columns=["task_id", "ver", "id", "change"])] if out else []

    def finish(self, over: list[tuple[Any, tuple]]) -> list[pd.DataFrame]:
        return self._changes([(k, None, s[0], "removed") for k, (streams,) in over for s in streams])


class Recorder(OrderedProcessor):
    """Remembers the running recording of a stream and which elementary streams it takes.

    Rows are packets and commands; an accepted start opens a recording, a stop ends it. The first
    video and the first audio packet of a recording choose its elementary streams; audio waits
    until there is video, and what waits when the recording ends without any is left out.
    """

    order = ("kind_", "order_")
    columns_kept = "session long, video int, audio int, holds boolean"

    def __init__(self, columns: list[str], bucket_ms: int, idle_ms: int | None = None):
        super().__init__(bucket_ms, idle_ms)
        self.columns = columns

    def open(self, handle: StatefulProcessorHandle) -> None:
        #: Packets of recordings that have no video yet, by part.
        self.held = handle.getMapState("held", "part long", "rows binary")

    def begin(self) -> None:
        #: The packets held before, once they are asked for, and those held since.
        self.old: pd.DataFrame | None = None
        self.added: list[pd.DataFrame] = []

    def _taken(self, names: list) -> pd.DataFrame:
        """The held packets of these streams, which are no longer held."""
        parts = [] if self.old is not None else [unpacked(self.held.getValue(p)[0]) for p in sorted(self.held.keys())]
        rows = pd.concat([*([] if self.old is None else [self.old]), *parts, *self.added], ignore_index=True)
        mine = rows["stream_id"].isin(names)
        self.old, self.added = rows[~mine], []
        return rows[mine]

    def settle(self) -> None:
        if self.old is not None:
            self.held.clear()
            self.added = [self.old, *self.added]
        self.added = [rows for rows in self.added if len(rows)]
        if self.added:
            last = max((part for (part,) in self.held.keys()), default=-1)
            self.held.updateValue((last + 1,), (packed(pd.concat(self.added, ignore_index=True)),))

    def step(self, runs: Runs, rows: pd.DataFrame) -> tuple[list[tuple], list[pd.DataFrame]]:
        none = (None, None, None, False)
        before = [b or none for b in runs.before]
        action, media, index = (rows[c].to_numpy() for c in ("action", "media", "stream_index"))
        told = rows["kind_"].to_numpy() == 0
        first = np.array([b[0] is not None for b in before])
        on, on_after = _before(runs, told, action == "start", first)
        accepted = told & (action == "start") & ~on
        # A run's rows up to its first accepted start are of the recording it came with, if any.
        opened = np.cumsum(accepted)
        recording = runs.of_rows + opened
        came = np.arange(len(before)) + opened[runs.bounds[:-1]] - accepted[runs.bounds[:-1]]
        last = recording[runs.bounds[1:] - 1]
        count = len(before) + int(opened[-1])
        session = np.zeros(count, dtype=np.int64)
        session[came] = [b[0] if b[0] is not None else 0 for b in before]
        session[recording[accepted]] = rows["order_"].to_numpy()[accepted]
        packet = ~told & on
        chosen = {m: self._chosen(packet & (media == m), index, recording, count, came, [b[k] for b in before])
                  for m, k in (("video", 1), ("audio", 2))}
        taken = np.zeros(len(rows), dtype=bool)
        for m, (has, choice) in chosen.items():
            taken |= packet & (media == m) & has[recording] & (index == choice[recording])
        has_video, video = chosen["video"]
        stays = on_after & ~runs.ended
        held = taken & ~has_video[recording] & (recording == last[runs.of_rows]) & stays[runs.of_rows]
        kept = rows[taken].assign(session_id=session[recording[taken]])
        kept["out_index"] = [OUT_INDEX[m] for m in media[taken]]
        kept = kept[["session_id", "out_index", *self.columns]]
        out = [kept[has_video[recording[taken]]]]
        holding = np.array([bool(b[3]) for b in before])
        freed, dropped = holding & has_video[came], holding & ~has_video[came] & ~(stays & (last == came))
        if (freed | dropped).any():
            names = [runs.keys[k] for k in np.flatnonzero(freed).tolist()]
            gone = [runs.keys[k] for k in np.flatnonzero(dropped).tolist()]
            held_before = self._taken(names + gone)
            out.append(held_before[held_before["stream_id"].isin(names)])
        if held.any():
            self.added.append(kept[held[taken]])
        holds = holding & ~freed & ~dropped
        holds[np.unique(runs.of_rows[held])] = True
        has_audio, audio = chosen["audio"]
        after = [
            (s, v if hv else None, a if ha else None, h) if still else none
            for still, s, hv, v, ha, a, h in zip(
                stays.tolist(), session[last].tolist(), has_video[last].tolist(), video[last].tolist(),
                has_audio[last].tolist(), audio[last].tolist(), holds.tolist(), strict=True,
            )
        ]
        return after, [rows for rows in out if len(rows)]

    def _chosen(
        self, packets: np.ndarray, index: np.ndarray, recording: np.ndarray, count: int, came: np.ndarray, before: list
    ) -> tuple[np.ndarray, np.ndarray]:
        """Whether each recording has an elementary stream of a medium, and which."""
        has, choice = np.zeros(count, dtype=bool), np.zeros(count, dtype=np.int64)
        has[came] = [b is not None for b in before]
        choice[came] = [b if b is not None else 0 for b in before]
        places = np.flatnonzero(packets)
        found, first = np.unique(recording[places], return_index=True)
        first, found = first[~has[found]], found[~has[found]]
        has[found], choice[found] = True, index[places[first]]
        return has, choice

    def finish(self, over: list[tuple[Any, tuple]]) -> list[pd.DataFrame]:
        if gone := [k for k, state in over if state[3]]:
            self._taken(gone)
        return []


class SegmentCutter(OrderedProcessor):
    """Remembers the open segment and gives its playlist row when the next one begins.

    A segment begins with the first row and with the first key frame of each later span.
    """

    order = ("t", "frame_id")
    columns_kept = "span long, segment long, start double, end double, n long"

    def __init__(self, seconds: int, bucket_ms: int, idle_ms: int | None = None):
        super().__init__(bucket_ms, idle_ms)
        self.seconds = seconds

    def step(self, runs: Runs, rows: pd.DataFrame) -> tuple[list[tuple], list[pd.DataFrame]]:
        t, starts, run = rows["t"].to_numpy(), runs.bounds[:-1], runs.of_rows
        spans = np.floor(t / self.seconds).astype(np.int64)
        open_now = [b or (s, 0, a, a, 0) for b, s, a in zip(runs.before, spans[starts].tolist(), t[starts].tolist())]
        keys = np.flatnonzero(rows["is_key"].to_numpy().astype(bool))
        begins = keys[~pd.DataFrame({"run": run[keys], "span": spans[keys]}).duplicated().to_numpy()]
        begins = begins[spans[begins] != np.array([s[0] for s in open_now])[run[begins]]]
        # pieces of open segments and of those that begin here, in order
        lows = np.concatenate((starts, begins))
        place = np.argsort(lows, kind="stable")
        lows, begun = lows[place].tolist(), (place >= len(starts)).tolist()
        owners, spans, t = run[lows].tolist(), spans.tolist(), t.tolist()
        after, closed = list(open_now), []
        for low, high, new, k in zip(lows, [*lows[1:], len(t)], begun, owners):
            span, segment, start, end, n = after[k]
            if new:
                closed.append((runs.keys[k], segment, start, end, n))
                span, segment, start, n = spans[low], segment + 1, t[low], 0
            if high > low:
                end, n = t[high - 1], n + high - low
            after[k] = (span, segment, start, end, n)
        return after, self._playlist(closed)

    def _playlist(self, closed: list[tuple]) -> list[pd.DataFrame]:
        return [pd.DataFrame(closed, columns=["stream_id", "segment_no", "start_t", "end_t", "n"])] if closed else []

    def finish(self, over: list[tuple[Any, tuple]]) -> list[pd.DataFrame]:
        return self._playlist([(k, *state[1:]) for k, state in over])
