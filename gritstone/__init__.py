"""Batch retrieval, grounding and evaluation over document collections as Spark DataFrame jobs."""
