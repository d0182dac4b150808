"""Facades over classes: results, aggregates, sections, edits."""
