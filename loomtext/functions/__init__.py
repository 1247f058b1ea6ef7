"""Column functions: text normalization, splitting and byte alphabets."""
