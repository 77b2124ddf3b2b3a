"""Column functions and byte parsers."""
