"""Spark-first analytics over corpora of text and source files."""
