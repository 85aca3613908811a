"""Incremental ingest: only what is new since the last run."""
