"""Structured Streaming counterparts of ingest and status keeping."""
