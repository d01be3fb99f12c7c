"""Structured Streaming: change-event ingest and state upkeep."""
