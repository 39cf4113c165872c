"""Column expressions: conditions, seeds, generators, scrambling, JSON paths."""
