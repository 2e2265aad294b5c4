"""Batch and streaming ingest."""

from tidemark.streaming.ingest import IngestSummary, cancel, ingest_file, ingest_rows, ingest_stream

__all__ = ["IngestSummary", "cancel", "ingest_file", "ingest_rows", "ingest_stream"]
