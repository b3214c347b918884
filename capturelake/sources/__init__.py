"""Sources of the capture engine."""
