"""Scalar functions: column expressions and Arrow functions."""
