"""Operators: tables to tables."""
