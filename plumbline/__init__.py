"""Consistency and corpus-quality analytics as Spark DataFrame operators."""
