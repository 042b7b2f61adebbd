"""Spark-first engine for conversational memory tables and retrieval."""
