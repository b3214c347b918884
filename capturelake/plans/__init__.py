"""Plans of the capture engine."""
