"""Column functions: symbol text, paths, ranges, documentation. All are built from Spark's own functions."""
