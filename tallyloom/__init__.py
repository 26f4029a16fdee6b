"""Retail click-stream analytics on PySpark DataFrames."""
