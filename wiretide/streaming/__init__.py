"""streaming of the capture engine."""
