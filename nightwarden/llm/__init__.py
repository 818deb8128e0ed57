"""Operators for preparing training text on Spark, each with its registered query."""
