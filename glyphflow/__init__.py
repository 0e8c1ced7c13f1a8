"""glyphflow: document-image analytics and corpus preparation as PySpark DataFrames."""

__version__ = "0.1.0"
