"""Stored tables: manifests, segments, locks and ingestion."""
