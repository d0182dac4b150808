"""Predicates: text to syntax tree to DataFrame."""
