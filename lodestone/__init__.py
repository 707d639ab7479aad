"""Spark-first evidence retrieval, ranking and evaluation engine."""
