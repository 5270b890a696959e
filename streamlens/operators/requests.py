"""Checking JSON job requests in bulk: a code and a message per request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamlens.functions.media import (
    FILE_ONLY_METHODS,
    RECORDING_METHODS,
    SCREENSHOT_METHODS,
    has_recording_suffix,
    is_live,
    method_allowed,
    task_key,
)
from streamlens.operators.cells import DEFAULT_CELL_SECONDS
from streamlens.operators.control import NOT_FOUND, NOT_RUNNING, RUNNING, outcome, with_task_state
from streamlens.operators.layout import streams_schema, valid_streams

# Response codes and texts, which callers compare.
SUCCESS = 1000
INVALID_REQUEST = 2001
INVALID_JSON = 2002

INVALID_JSON_TEXT = "Invalid JSON"
MISSING_FIELD = "Missing fields: Missing "
INVALID_ACTION = "Invalid action. Valid actions are 'start' or 'stop'."

FILE_ONLY = "Percentage and specific time screenshot are not supported for streams."
LIVE_ONLY = "Immediate screenshot is only supported for streams."
UNKNOWN_SCREENSHOT = "Invalid screenshot method."
BAD_INTERVAL = "Interval must be positive."
BAD_PERCENTAGE = "Percentage must be between 1 and 100."
BAD_TIME = "time_second must be non-negative."
SCREENSHOT_STARTED = "Screenshot task started."
SCREENSHOT_STOPPED = "Screenshot task stopped successfully."
SCREENSHOT_RUNNING = "A screenshot task with the same stream URL and method is already running."
SCREENSHOT_NOT_RUNNING = "No running screenshot task found for this stream."

BAD_FILE_NAME = "Filename must end with .mp4 or .m3u8."
RECORDING_LIVE_ONLY = "Recording is only supported for streams."
UNKNOWN_RECORDING = "Invalid recording method."
RECORDING_STARTED = "Recording task started."
RECORDING_STOPPED = "Recording task stopped successfully."
RECORDING_RUNNING = "A recording task with the same stream URL and method is already running."
RECORDING_NOT_RUNNING = "No running recording task found for this stream."

NO_RESOLUTION = "Missing required fields: 'resolution'."
MIX_LIVE_ONLY = "Mixing is only supported for RTMP streams."
RESOLUTION_PARTS = "Resolution requires both 'width' and 'height'."
RESOLUTION_SIZE = "Resolution dimensions must be positive integers."
MIX_PARAMETERS = "Failed to parse mixing parameters."
MIX_NO_STREAMS = "Missing fields: 'streams'"
MIX_STARTED = "Mixing task started."
MIX_UPDATED = "Mixing task updated successfully"
MIX_RUNNING = "A mixing task with the same RTMP URL is already running."
MIX_NOT_RUNNING = "No running task found for the given URL."

MIX_METHOD = "mix"

_TASK_FIELDS = (
    "stream_url",
    "method",
    "action",
    "interval",
    "percentage",
    "time_second",
    "filename_name",
)
_MIX_FIELDS = ("output_url", "action", "background_image", "resolution", "streams")


def _b(field: str) -> Column:
    return F.col(f"_b_{field}")


def whole_document(body: str) -> Column:
    """Whether a body is one JSON value and nothing else.

    The readers of JSON stop where the first value ends. In brackets, alone and before another value, a
    body is one element of one and of two only if nothing follows it, a bracket of its own neither. Names
    that occur twice are allowed, which the strict reader refuses.
    """
    alone = F.json_array_length(F.concat(F.lit("["), body, F.lit("]"))) == 1
    followed = F.json_array_length(F.concat(F.lit("["), body, F.lit(",0]"))) == 2
    names = F.json_object_keys(body)
    strict = F.try_parse_json(body).isNotNull() | (F.size(F.array_distinct(names)) < F.size(names))
    return F.coalesce(alone & followed & strict, F.lit(False))


def _parsed(df: DataFrame, body: str, fields: Sequence[str]) -> DataFrame:
    """Add ``_fields``, the names present (NULL for a body that is not one object), and each field.

    ``json_tuple`` reads a body once for all fields, however many checks use them.
    """
    present = df.withColumn("_fields", F.when(whole_document(body), F.json_object_keys(body)))
    return present.select("*", F.json_tuple(body, *fields).alias(*[f"_b_{f}" for f in fields]))


def _missing(required: Sequence[str]) -> Column:
    """The alphabetically first required field that is absent, NULL if none is."""
    absent = [F.when(~F.array_contains("_fields", f), F.lit(f)) for f in sorted(required)]
    return F.coalesce(*absent)


def _number(text: Column) -> Column:
    """A whole number; a fraction is cut off, and what is no number gives NULL."""
    return text.try_cast("double").try_cast("int")


def _common(required: Sequence[str], actions: Sequence[str]) -> list[tuple[Column, int, Column]]:
    missing = _missing(required)
    action = _b("action")
    return [
        (F.col("_fields").isNull(), INVALID_JSON, F.lit(INVALID_JSON_TEXT)),
        (missing.isNotNull(), INVALID_REQUEST, F.concat(F.lit(MISSING_FIELD), missing)),
        (
            action.isNull() | ~action.isin(*actions),
            INVALID_REQUEST,
            F.lit(INVALID_ACTION),
        ),
    ]


def _verdict(checks: Sequence[tuple[Column, int, Column | str]]) -> tuple[Column, Column]:
    """Code and message of the first check that applies."""
    code = message = F
    for test, number, text in checks:
        code = code.when(test, number)
        message = message.when(test, text if isinstance(text, Column) else F.lit(text))
    return code, message


def _refuse(test: Column, text: str) -> tuple[Column, int, str]:
    return F.coalesce(test, F.lit(True)), INVALID_REQUEST, text


def _judge(df: DataFrame, checks: Sequence[tuple[Column, int, Column | str]]) -> DataFrame:
    return df.withColumns({c: v for c, v in zip(("code", "message"), _verdict(checks))})


def _judge_screenshot(df: DataFrame, body: str) -> DataFrame:
    parsed = _parsed(df, body, _TASK_FIELDS)
    method, suits = _b("method"), method_allowed(_b("method"), _b("stream_url"))
    interval, percentage, second = map(
        _number, (_b("interval"), _b("percentage"), _b("time_second"))
    )
    checks = _common(("stream_url", "method", "action"), ("start", "stop")) + [
        (_b("action") != "start", SUCCESS, SCREENSHOT_STOPPED),
        (~suits & method.isin(*FILE_ONLY_METHODS), INVALID_REQUEST, FILE_ONLY),
        (~suits, INVALID_REQUEST, LIVE_ONLY),
        _refuse(~method.isin(*SCREENSHOT_METHODS), UNKNOWN_SCREENSHOT),
        _refuse((method == "interval") & (interval <= 0), BAD_INTERVAL),
        _refuse((method == "percentage") & ~percentage.between(1, 100), BAD_PERCENTAGE),
        _refuse((method == "specific_time") & (second < 0), BAD_TIME),
        (F.lit(True), SUCCESS, SCREENSHOT_STARTED),
    ]
    return _judge(parsed, checks)


def _judge_recording(df: DataFrame, body: str) -> DataFrame:
    parsed = _parsed(df, body, _TASK_FIELDS)
    checks = _common(("stream_url", "method", "action"), ("start", "stop")) + [
        (_b("action") != "start", SUCCESS, RECORDING_STOPPED),
        _refuse(~has_recording_suffix(_b("filename_name")), BAD_FILE_NAME),
        _refuse(~is_live(_b("stream_url")), RECORDING_LIVE_ONLY),
        _refuse(~_b("method").isin(*RECORDING_METHODS), UNKNOWN_RECORDING),
        (F.lit(True), SUCCESS, RECORDING_STARTED),
    ]
    return _judge(parsed, checks)


def _judge_mix(df: DataFrame, body: str) -> DataFrame:
    usable = F.size(valid_streams(F.from_json(_b("streams"), streams_schema())))
    parsed = _parsed(df, body, _MIX_FIELDS).withColumn("n_streams", F.coalesce(usable, F.lit(0)))
    start = _b("action") == "start"
    width, height = (F.get_json_object(_b("resolution"), f"$.{s}") for s in ("width", "height"))
    positive = (_number(width) > 0) & (_number(height) > 0)
    no_streams = F.col("n_streams") == 0
    checks = _common(("output_url", "action", "streams"), ("start", "update")) + [
        (start & ~F.array_contains("_fields", "resolution"), INVALID_REQUEST, NO_RESOLUTION),
        _refuse(~is_live(_b("output_url")), MIX_LIVE_ONLY),
        (start & (width.isNull() | height.isNull()), INVALID_REQUEST, RESOLUTION_PARTS),
        _refuse(start & ~positive, RESOLUTION_SIZE),
        (start & (_b("background_image").isNull() | no_streams), INVALID_REQUEST, MIX_PARAMETERS),
        (start, SUCCESS, MIX_STARTED),
        (no_streams, INVALID_REQUEST, MIX_NO_STREAMS),
        (F.lit(True), SUCCESS, MIX_UPDATED),
    ]
    return _judge(parsed, checks)


def validate_screenshot(df: DataFrame, body: str = "body", request: str = "req_id") -> DataFrame:
    """Code and message of each screenshot request; a valid one gets the success text."""
    return _judge_screenshot(df, body).select(request, "code", "message")


def validate_recording(df: DataFrame, body: str = "body", request: str = "req_id") -> DataFrame:
    """Code and message of each recording request."""
    return _judge_recording(df, body).select(request, "code", "message")


def validate_mix(df: DataFrame, body: str = "body", request: str = "req_id") -> DataFrame:
    """Code, message and number of usable streams of each mix request."""
    return _judge_mix(df, body).select(request, "code", "message", "n_streams")


def request_outcomes(verdicts: DataFrame) -> DataFrame:
    """How many requests ended with each code and message."""
    return verdicts.groupBy("code", "message").agg(F.count(F.lit(1)).alias("n"))


_RESPONSES = {
    "screenshot": (_judge_screenshot, SCREENSHOT_RUNNING, SCREENSHOT_NOT_RUNNING),
    "recording": (_judge_recording, RECORDING_RUNNING, RECORDING_NOT_RUNNING),
    "mix": (_judge_mix, MIX_RUNNING, MIX_NOT_RUNNING),
}


def _earliest(kind: T.DataType) -> Column:
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    return F.lit("0001-01-01").cast(kind)


def _known(part: Column) -> Column:
    """A part of a task key that is null differs from every text, and equals itself."""
    return F.coalesce(F.concat(F.lit("="), part), F.lit(""))


def respond(
    df: DataFrame,
    job: str,
    body: str = "body",
    time: str = "ts",
    cell_seconds: int = DEFAULT_CELL_SECONDS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Code and message of each request, given the accepted ones before it: one answer each.

    Columns ``keep`` of the requests go with their answers. Requests that pass the checks become commands on their task key; a start of a
    running task, or a stop or update of one that is not running, is refused.
    """
    judge, running, not_running = _RESPONSES[job]
    url, method = (
        (_b("output_url"), F.lit(MIX_METHOD)) if job == "mix" else (_b("stream_url"), _b("method"))
    )
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(True)
    verdicts = judge(df.select("req_id", time, body, kept.alias("_kept")), body).select(
        "req_id",
        "_kept",
        # a request without a time comes before all others of its task
        F.coalesce(F.col(time), _earliest(df.schema[time].dataType)).alias(time),
        task_key(_known(url), _known(method)).alias("_task"),
        _b("action").alias("action"),
        "code",
        "message",
    )
    commands = verdicts.filter(F.col("code") == SUCCESS).select("_task.*", *verdicts.columns)
    judged = with_task_state(
        commands.drop("_task"), ("stream_url", "method"), time, "req_id", cell_seconds
    ).withColumn("_outcome", outcome())
    refused = F.col("_outcome").isin(RUNNING, NOT_RUNNING, NOT_FOUND)
    text = F.when(F.col("_outcome") == RUNNING, running).otherwise(not_running)
    answered = judged.select(
        "req_id",
        F.when(refused, INVALID_REQUEST).otherwise(F.col("code")).alias("code"),
        F.when(refused, text).otherwise(F.col("message")).alias("message"),
        "_kept",
    )
    rejected = verdicts.filter(F.col("code") != SUCCESS).select("req_id", "code", "message", "_kept")
    return answered.unionByName(rejected).select(
        "req_id", "code", "message", *[F.col("_kept").getField(c).alias(c) for c in keep]
    )
