"""Column functions: pure expressions over text, vectors, paths and dates."""
