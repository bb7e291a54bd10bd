"""Operators that turn large record extracts into analysis-ready tables, on Spark."""
