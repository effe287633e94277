"""Column-in, Column-out scalar functions."""
