"""Checks and the operators that they are made of."""
