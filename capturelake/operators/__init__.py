"""Operators of the capture engine."""
