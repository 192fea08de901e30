"""Structured Streaming jobs: message ingest, life cycles as keyed state, counts per business day."""
