"""Compilers that run on the driver: schemas to patterns, patterns to automata."""
