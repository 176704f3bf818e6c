"""Semantic code search and feedback analytics as Spark DataFrame operators."""
