"""Column functions: text, answer metrics and vectors."""
