"""plans of the page alignment engine."""
