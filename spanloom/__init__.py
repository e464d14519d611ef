"""Span-relational text analytics on Spark."""
