"""Column functions: geometry, validity, robust statistics."""
