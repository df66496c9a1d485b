"""plans of the capture engine."""
