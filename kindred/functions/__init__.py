"""Column expressions: text normalisation and similarity."""
