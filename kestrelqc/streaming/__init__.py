"""Checks on streams."""
