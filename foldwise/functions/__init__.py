"""Column expressions: hashing, formulas, conditional and special functions."""
