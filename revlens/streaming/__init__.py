"""Structured Streaming: incremental ingest, de-duplication, first rows, windowed counts."""

from .ingest import (BYTES_PER_TRIGGER, ingest_exactly_once, ingest_incremental, stage_files, stream_counts,
                     stream_dedup)
from .keep_first import stream_keep_first

__all__ = ["BYTES_PER_TRIGGER", "ingest_exactly_once", "ingest_incremental", "stream_dedup", "stream_counts",
           "stream_keep_first", "stage_files"]
