"""Sources of the document-image engine."""
