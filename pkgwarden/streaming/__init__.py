"""Delivery of results in chunks. The inputs are finite, so there is no unbounded stream."""

from pkgwarden.streaming.delivery import json_rows, stream_ndjson, write_ndjson

__all__ = ["json_rows", "stream_ndjson", "write_ndjson"]
