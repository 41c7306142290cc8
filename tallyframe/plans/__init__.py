"""Composed plans: derived tables, ingest runs, adapters, sinks, snapshots."""
