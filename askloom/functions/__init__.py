"""Column expressions: text, vectors, JSON and request scalars."""
