"""Retail outlet analytics on Spark: storelens."""
