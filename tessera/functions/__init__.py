"""Column expressions and small statistics."""
