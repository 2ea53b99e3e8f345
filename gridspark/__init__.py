"""Interval-market analytics as PySpark DataFrame jobs."""
