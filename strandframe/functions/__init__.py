"""Column functions: scalar sequence, quality and statistical expressions."""
