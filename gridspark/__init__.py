"""Leakage-safe, event-ordered analytics on PySpark DataFrames."""
