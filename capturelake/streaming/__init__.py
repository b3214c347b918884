"""Streaming of the capture engine."""
