"""Capture analytics on Spark: packets, sessions, graphs, queries and training-data operators."""
