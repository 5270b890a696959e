"""Recording: packets inside accepted sessions, routed, rescaled and written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlens.functions.media import MICROS
from streamlens.operators.cells import CELL, DEFAULT_CELL_SECONDS, kept_by_cell, set_aside
from streamlens.operators.control import record_sessions, sessions_from_commands
from streamlens.operators.recording import rescale_packets, route_media, with_time_base
from streamlens.sinks.recorders import record
from streamlens.sources.frames import to_frames


def recorded_packets(
    frames: DataFrame,
    commands: DataFrame,
    video_tb: tuple[int, int] = MICROS,
    audio_tb: tuple[int, int] = MICROS,
    out_video_tb: tuple[int, int] = (1, 90_000),
    out_audio_tb: tuple[int, int] = (1, 90_000),
    cell_seconds: int = DEFAULT_CELL_SECONDS,
    per_recording: bool = False,
    at_frame_rate: bool = False,
    methods: Sequence[str] | None = None,
) -> DataFrame:
    """Packets of each recording, ready to be written, with the session they belong to.

    ``per_recording`` lets each recording choose its elementary streams by its own first packets,
    as live recordings do; otherwise an input's choice holds for all its recordings.
    ``at_frame_rate`` moves video to the inverse of each recording's frame rate and leaves audio in
    its own time base; both are then given as ``tb_num`` and ``tb_den``. With ``methods`` the commands
    carry a ``method`` and one input is recorded by several at once; packets then give theirs.
    """
    keys = ["stream_id"] if methods is None else ["stream_id", "method"]
    sessions = sessions_from_commands(commands, keys, cell_seconds=cell_seconds)
    rest = [c for c in frames.columns if c not in ("stream_id", "frame_id", "ts")]
    inside = record_sessions(frames, sessions, rest, cell_seconds, True, methods)
    packets = kept_by_cell(inside, ["stream_id"], "recorded")
    if per_recording:
        routed = route_media(packets, "ts", keys=("stream_id", "session_id"), by_time=True)
    else:
        routed = route_media(packets)
    if at_frame_rate:
        based = with_time_base(routed, video_tb, audio_tb).drop(CELL)
        out_tb = (F.col("tb_num"), F.col("tb_den"))
        return rescale_packets(based, video_tb, audio_tb, out_tb, out_tb)
    routed = routed.drop(CELL)
    return rescale_packets(routed, video_tb, audio_tb, out_video_tb, out_audio_tb)


def save_recording(packets: DataFrame, method: str, path: str, **options) -> None:
    record(packets, method, path, **options)


def record_inputs(
    raw: DataFrame,
    commands: DataFrame,
    method: str,
    path: str,
    cell_seconds: int = DEFAULT_CELL_SECONDS,
    folders: int | None = None,
    **params,
) -> None:
    """Record raw packets as the commands say: the recordings, and beside them what has no place in any.

    Packets and commands without a stream or a time are in ``unplaced/packets`` and ``unplaced/commands``.
    Many inputs can share a number of ``folders``.
    """
    placed = set_aside(raw, f"{path}/unplaced/packets")
    told = set_aside(commands, f"{path}/unplaced/commands")
    frames = to_frames(placed, cell_seconds=cell_seconds)
    timed = frames if "dts" in frames.columns else frames.withColumn("dts", F.col("pts"))
    packets = recorded_packets(timed, told, cell_seconds=cell_seconds, **params)
    save_recording(packets, method, f"{path}/{method}", **({} if folders is None else {"folders": folders}))
