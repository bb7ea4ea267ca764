"""Operators for the preparation of training text, written as Spark DataFrame jobs."""
