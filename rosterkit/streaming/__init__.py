"""Continuous request intake with Structured Streaming.

The reference has no streaming operators (no windows, watermarks or
state); its requests arrive one by one over HTTP.  The Spark re-aim is a
stateless stream over a folder of JSON request files: each micro-batch
is checked (required fields, trimming) and split into accepted requests
and rejects, both appended as Parquet.  The batch operators then apply
accepted requests set-wise.
"""

from .intake import request_stream, start_intake

__all__ = ["request_stream", "start_intake"]
