"""Compositions of operators that answer a whole study question."""
