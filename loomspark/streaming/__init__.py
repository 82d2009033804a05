"""Incremental and streaming forms.

The reference has no streams; its incremental behaviours (skip unchanged files,
append-only audit, repeated polling of run health) are expressed with Structured
Streaming: a file source with a checkpoint, ``foreachBatch`` sinks, and a watermarked
windowed aggregation.
"""
