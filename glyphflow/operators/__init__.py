"""Operators of the document-image engine."""
