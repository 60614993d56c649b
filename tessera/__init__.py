"""Spark-first analytics over a corpus of linked documents."""
