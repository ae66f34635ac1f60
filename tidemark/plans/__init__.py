"""Compositions of operators: ranked recall."""
