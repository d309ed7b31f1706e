"""Retail, stock and demand analytics as Spark DataFrame operators."""
