"""Ingestion of records as they arrive (beyond the batch engine)."""
