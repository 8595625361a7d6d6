"""Incremental ingestion of document folders with Structured Streaming."""
