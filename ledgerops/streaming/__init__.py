"""Structured Streaming versions of the clean, filter and aggregate tools."""

from .files import clean_stream, file_stream, filter_stream, run_available, running_totals

__all__ = ["clean_stream", "file_stream", "filter_stream", "run_available", "running_totals"]
