"""Column expressions and argument checks."""
