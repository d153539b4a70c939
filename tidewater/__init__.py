"""Recommendation and user-analytics operators on PySpark."""
