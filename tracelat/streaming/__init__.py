"""Structured Streaming: stateful pairing and per-probe ingest queries."""
