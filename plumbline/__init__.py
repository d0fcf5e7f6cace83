"""Tabular profiling, scoring and model search as Spark jobs."""
