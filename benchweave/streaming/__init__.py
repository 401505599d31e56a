"""Structured Streaming counterparts of the incremental accumulators."""
