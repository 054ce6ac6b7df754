"""Column expressions and the few per-row helpers that Spark has no function for."""
