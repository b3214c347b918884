"""Queries of the capture engine."""
