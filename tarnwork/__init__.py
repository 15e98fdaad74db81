"""Spark operators for semi-structured records and their measurements."""
