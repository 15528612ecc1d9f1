"""Column functions: text, mathematics, vectors, statistics."""
