"""Readers, type inference on ingest, and the Parquet sink."""
