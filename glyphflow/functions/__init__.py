"""Functions of the document-image engine."""
