"""Spark-first operators for dependency graphs, diagnostics and run records."""
