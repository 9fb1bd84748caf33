"""Column expressions with the NULL, rounding and text rules of the agreement tables."""
