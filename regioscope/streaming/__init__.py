"""Incremental processing of snapshot folders with Structured Streaming."""
