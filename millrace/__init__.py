"""millrace: a PySpark-native catalogue quality, enrichment and corpus engine."""

__version__ = "0.1.0"
