"""Sampling, recording and layout analysis of timestamped media streams on Spark."""

from streamlens.operators.sampling import register_sampler, sample
from streamlens.sinks.recorders import record, register_recorder
from streamlens.sources.frames import to_frames
from streamlens.sources.packets import read_packet_stream, read_packets

__all__ = [
    "read_packet_stream",
    "read_packets",
    "record",
    "register_recorder",
    "register_sampler",
    "sample",
    "to_frames",
]
