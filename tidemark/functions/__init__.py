"""Column functions of the engine."""

from tidemark.functions.time import BUCKET_NS, bucket_of, half_open, nanos

__all__ = ["BUCKET_NS", "bucket_of", "half_open", "nanos"]
