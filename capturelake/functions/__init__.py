"""Functions of the capture engine."""
