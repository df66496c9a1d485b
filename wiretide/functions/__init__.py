"""functions of the capture engine."""
