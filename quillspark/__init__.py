"""Spark-first analytics over news-style events, documents and nested JSON."""
