"""Column expressions and small reusable DataFrame helpers."""
