"""Column functions: seeded hashes, array helpers, Student-t quantile."""
