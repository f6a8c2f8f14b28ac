"""Spark-first analytics over versioned legal text."""
