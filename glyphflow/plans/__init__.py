"""Plans of the document-image engine."""
