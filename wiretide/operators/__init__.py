"""operators of the capture engine."""
