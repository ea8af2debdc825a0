"""operators of the page alignment engine."""
