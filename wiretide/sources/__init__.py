"""sources of the capture engine."""
