"""Stateful streams."""
