"""Compositions of operators, and the query catalogue over the driver's tables."""
