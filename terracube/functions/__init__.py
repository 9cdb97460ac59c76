"""Column expressions: transforms and skill metrics."""
