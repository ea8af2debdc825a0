"""functions of the page alignment engine."""
