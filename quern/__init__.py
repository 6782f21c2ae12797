"""quern: governed-metric and document-corpus analytics on PySpark."""

__version__ = "0.1.0"
