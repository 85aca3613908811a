"""Scalar functions as Column expressions, and their registry."""
