"""streaming of the page alignment engine."""
