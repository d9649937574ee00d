"""Column functions: text, hashing, geometry."""
