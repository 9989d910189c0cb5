"""Column expressions: casts from text and column statistics."""
