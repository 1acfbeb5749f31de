"""Lattica: code-graph analytics and training-data operators as Spark jobs."""
