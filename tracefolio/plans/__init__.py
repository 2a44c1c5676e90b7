"""Whole plans: operators composed to queries."""
