"""Operators on collections: selection, references, changes, validation, statistics."""
