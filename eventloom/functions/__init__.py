"""Column expressions: statistics, binary reads and label helpers."""
