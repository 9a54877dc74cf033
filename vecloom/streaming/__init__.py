"""Shards that arrive over time."""

from vecloom.streaming.shards import scan_indexed, stream_indexed, stream_prepare, stream_shards

__all__ = ["scan_indexed", "stream_indexed", "stream_prepare", "stream_shards"]
