"""Column expressions: text, vectors, scores and rankings."""
