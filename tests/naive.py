"""Loops over one stream in order: what the operators must give."""

import math


def interval(rows, gap):
    last, kept = 0, []
    for t, frame in sorted(rows):
        if t - last >= gap:
            kept.append(frame)
            last = int(t)
    return kept


def percentage(rows, pct, duration):
    last, kept = 0.0, []
    total = float(int(duration))
    for t, frame in sorted(rows):
        if total == 0:
            share = math.inf if t > 0 else math.nan
        else:
            share = t / total * 100
        if share - last >= pct:
            kept.append(frame)
            last = share
    return kept


def first_at(rows, at, count=1):
    return [frame for t, frame in sorted(rows) if t >= at][:count]


def sessions(times, limit):
    out = []
    for t in sorted(times):
        if out and t - out[-1][-1] <= limit:
            out[-1].append(t)
        else:
            out.append([t])
    return [(no, s[0], s[-1], len(s)) for no, s in enumerate(out)]


def outcomes(commands):
    active, out = False, []
    for ts, event, action in sorted(commands):
        if action == "start":
            out.append((event, "already_running" if active else "started"))
            active = True
        elif action == "stop":
            out.append((event, "stopped" if active else "not_running"))
            active = False
        else:
            out.append((event, "updated" if active else "not_found"))
    return out


def command_sessions(commands):
    out, current = [], None
    for ts, event, action in sorted(commands):
        if action == "start" and current is None:
            current = [event, ts, None]
            out.append(current)
        elif action == "stop" and current is not None:
            current[2] = ts
            current = None
    return [tuple(s) for s in out]


def segments(rows, seconds):
    """rows: (t, frame, is_key)."""
    out, number, begun = [], -1, None
    for t, frame, key in sorted(rows):
        span = math.floor(t / seconds)
        if begun is None or (key and span != begun):
            number, begun = number + 1, span
        out.append((frame, number))
    return out


def replay(versions):
    """versions: lists of (id, url, geometry), each a full list; yields changes and urls."""
    active, changes, urls = {}, [], []
    for ver, streams in enumerate(versions):
        new = {i: (u, g) for i, u, g in streams}
        here = [(ver, i, "removed") for i in active if i not in new]
        active = {i: v for i, v in active.items() if i in new}
        for i, (u, g) in new.items():
            if i not in active:
                here.append((ver, i, "added"))
                active[i] = (u, g)
            elif active[i][1] != g:
                here.append((ver, i, "updated"))
                active[i] = (u, g)
            else:
                here.append((ver, i, "unchanged"))
        if ver:
            changes += here
        urls += [(ver, i, u) for i, (u, g) in active.items()]
    return changes, urls
