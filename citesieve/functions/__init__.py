"""Column expressions and adapters for user-supplied models."""
