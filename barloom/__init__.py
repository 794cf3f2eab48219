"""Equity-market analytics as Spark DataFrame operators."""
