"""Structured Streaming jobs: incremental ingest, rate monitoring, live metrics."""
