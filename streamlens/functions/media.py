"""Column functions on timestamps, names, URLs and request bodies."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and prefixes that decide results.
LIVE_PREFIX = "rtmp://"
RECORDING_SUFFIXES = (".mp4", ".m3u8")
SCREENSHOT_METHODS = ("interval", "percentage", "immediate", "specific_time")
FILE_ONLY_METHODS = ("percentage", "specific_time")
LIVE_ONLY_METHODS = ("immediate",)
RECORDING_METHODS = ("mp4", "hls")

TimeBase = tuple[int | Column, int | Column]
MICROS = (1, 1_000_000)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, as BIGINT, in any session time zone."""
    span = _col(ts) - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")

    def part(unit: str, each: int) -> Column:
        return (F.extract(F.lit(unit), span) * F.lit(each)).cast("bigint")

    # The longest units are BIGINT constants, the seconds a DECIMAL with six places.
    return (
        part("DAY", 86_400_000_000)
        + part("HOUR", 3_600_000_000)
        + F.extract(F.lit("MINUTE"), span).cast("bigint") * 60_000_000
        + part("SECOND", 1_000_000)
    )


def pts_to_seconds(pts: Column | str, num: int = 1, den: int = 1_000_000) -> Column:
    """Frame time in seconds: the tick count times the time base as a double."""
    return _col(pts).cast("double") * F.lit(num / den)


def rescale_ts(pts: Column | str, src_tb: TimeBase, dst_tb: TimeBase) -> Column:
    """Move a tick count between time bases; nearest, halves away from zero, NULL stays NULL.

    The terms of a time base are INT numbers, or columns of them. The product of a
    BIGINT and two INT terms does not fit a BIGINT, so the arithmetic is on
    DECIMAL(38,0), which holds it exactly. A result outside BIGINT is no time
    stamp and gives NULL.
    """
    x = _col(pts).cast("decimal(20,0)")
    up = _product(src_tb[0], dst_tb[1])
    down = _product(src_tb[1], dst_tb[0])
    doubled = (F.abs(x) * _exact(2) * up + down).cast("decimal(38,0)")
    most = (_exact(2**64 - 2) * down).cast("decimal(38,0)")
    rounded = F.when(
        doubled < most, F.call_function("div", doubled, (_exact(2) * down).cast("decimal(38,0)"))
    )
    return F.when(x < 0, -rounded).otherwise(rounded)


def _exact(n: int) -> Column:
    return F.lit(Decimal(n)).cast(f"decimal({len(str(abs(n)))},0)")


def _product(a: int | Column, b: int | Column) -> Column:
    """Of two INT terms, as a decimal of 19 digits."""
    if isinstance(a, int) and isinstance(b, int):
        return _exact(a * b).cast("decimal(19,0)")
    terms = [_exact(x) if isinstance(x, int) else x for x in (a, b)]
    return (terms[0].cast("decimal(10,0)") * terms[1].cast("decimal(10,0)")).cast("decimal(19,0)")


def best_ratio(num: Column, den: Column, limit: int) -> Column:
    """The fraction nearest to ``num / den`` whose terms are at most ``limit``, as STRUCT(num, den).

    Continued fractions: convergents are followed while they stay within the limit, then the
    last one is compared with the farthest step towards the next that still does. NULL where
    a term is NULL or negative, or ``den`` is 0.
    """
    def whole(x: Column) -> Column:
        return x.cast("decimal(38,0)")

    def room(before: Column, step: Column) -> Column:
        return F.when(step > 0, F.call_function("div", F.lit(limit) - before, step))

    def follow(s: Column, _: Column) -> Column:
        digit = F.call_function("div", s["n"], s["d"])
        p, q = whole(s["p0"] + digit * s["p1"]), whole(s["q0"] + digit * s["q1"])
        onward = F.struct(
            s["d"].alias("n"),
            whole(s["n"] - digit * s["d"]).alias("d"),
            s["p1"].alias("p0"),
            s["q1"].alias("q0"),
            p.alias("p1"),
            q.alias("q1"),
            s["whole"].alias("whole"),
        )
        return F.when((s["d"] > 0) & (p <= limit) & (q <= limit), onward).otherwise(s)

    def nearer(s: Column) -> Column:
        steps = F.least(room(s["p0"], s["p1"]), room(s["q0"], s["q1"]))
        p, q = s["p0"] + steps * s["p1"], s["q0"] + steps * s["q1"]
        exact = s["d"] * F.lit(2) * q <= s["whole"]
        chosen = [F.when(exact, a).otherwise(b).cast("bigint") for a, b in ((s["p1"], p), (s["q1"], q))]
        return F.struct(chosen[0].alias("num"), chosen[1].alias("den"))

    start = {"n": num, "d": den, "p0": F.lit(0), "q0": F.lit(1), "p1": F.lit(1), "q1": F.lit(0), "whole": den}
    state = F.struct(*[whole(value).alias(name) for name, value in start.items()])
    # Terms of convergents grow at least like Fibonacci numbers.
    digits = F.sequence(F.lit(1), F.lit(int(1.5 * limit.bit_length()) + 4))
    return F.when((num >= 0) & (den > 0), F.aggregate(digits, state, follow, nearer))


def progress_percent(t: Column | str, duration: Column | str) -> Column:
    """Share of a file already played, in percent of its whole-second duration.

    A file shorter than one second has no finite share and gives NULL here;
    the percentage sampler handles such files itself.
    """
    total = _col(duration).cast("bigint").cast("double")
    return F.try_divide(_col(t), total) * F.lit(100.0)


def url_basename(url: Column | str) -> Column:
    """Text after the last slash; all of it without one, empty if it ends in one."""
    return F.substring_index(_col(url), "/", -1)


def is_live(url: Column | str) -> Column:
    return F.startswith(_col(url), F.lit(LIVE_PREFIX))


def has_recording_suffix(name: Column | str) -> Column:
    first, second = (F.endswith(_col(name), F.lit(s)) for s in RECORDING_SUFFIXES)
    return first | second


def method_allowed(method: Column | str, url: Column | str) -> Column:
    """Whether a screenshot method suits the input: some need a file, one a live stream."""
    live = is_live(url)
    return (
        F.when(_col(method).isin(*FILE_ONLY_METHODS), ~live)
        .when(_col(method).isin(*LIVE_ONLY_METHODS), live)
        .otherwise(F.lit(True))
    )


def json_field_or_default(
    body: Column | str, field: str, default: Column | str
) -> Column:
    """A field of a JSON object as text, or the default where the field is absent."""
    return F.coalesce(F.get_json_object(_col(body), f"$.{field}"), _col(default))


def task_key(url: Column | str, method: Column | str) -> Column:
    """Identity of a task. A struct, since joining the texts could make two keys equal."""
    return F.struct(_col(url).alias("stream_url"), _col(method).alias("method"))


def segment_file_name(name: Column | str, n: Column | str) -> Column:
    """Segment name: the recording name up to its last dot, then a number of 3+ digits."""
    stem = F.regexp_replace(_col(name), r"\.[^.]*$", "")
    return F.format_string("%s_%03d.ts", stem, _col(n))
