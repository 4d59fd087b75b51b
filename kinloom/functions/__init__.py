"""Column functions: text, vectors, scoring and reply parsing."""
