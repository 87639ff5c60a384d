"""Incident analytics on Spark: DataFrame, SQL and Structured Streaming operators over many incidents at once."""
