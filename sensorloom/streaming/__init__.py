"""Structured Streaming: the same operators over unbounded readings."""
