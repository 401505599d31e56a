"""Column functions: names, paths, hashing, text and vectors."""
