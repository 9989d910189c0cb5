"""Operators for preparing training data: filtering, deduplication, redaction, packing, formatting."""
