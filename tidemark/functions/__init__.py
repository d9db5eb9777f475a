"""Column functions: time, text, sentiment."""
