"""sources of the page alignment engine."""
