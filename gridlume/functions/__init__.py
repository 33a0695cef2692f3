"""Column expressions: text, scalars and geometry."""
