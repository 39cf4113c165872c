"""cohort: referentially complete subsets and deterministic anonymizing on plain Spark."""
