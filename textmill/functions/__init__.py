"""Column functions and analyzers."""
