"""Column functions: text, vectors, rounding, conditions."""
