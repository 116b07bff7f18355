"""Column functions: text, vectors and rounding."""
