"""Column functions: vectors and text."""
