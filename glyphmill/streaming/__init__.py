"""Incremental jobs on Structured Streaming."""

from .jobs import dropped_rows, stream_decontaminate, stream_dedup, stream_flag_rate, stream_label, stream_quota

__all__ = ["dropped_rows", "stream_label", "stream_dedup", "stream_decontaminate", "stream_flag_rate", "stream_quota"]
