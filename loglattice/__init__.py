"""Spark-first analytics over agent-session histories and text corpora."""
