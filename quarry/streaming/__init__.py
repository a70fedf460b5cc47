"""Structured Streaming variant of the answer job."""

from quarry.streaming.answers import answer_stream

__all__ = ["answer_stream"]
