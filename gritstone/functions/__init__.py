"""Spark jobs of this package; see README.md."""
