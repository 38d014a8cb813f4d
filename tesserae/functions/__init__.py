"""Column functions and similarity functions."""
