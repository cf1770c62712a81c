"""Column expressions and small numerical functions."""
