"""Patterns and column expressions."""
