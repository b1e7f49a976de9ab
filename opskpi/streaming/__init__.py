"""Structured Streaming entry points.

The KPIs have no event-time or state semantics: each is a function of the
tables at one ``as_of``.  Freshness ("re-run when someone asks") is served by
:func:`opskpi.streaming.refresh.start_refresh`, a file-triggered stream whose
micro-batches run the batch snapshot job.
"""
