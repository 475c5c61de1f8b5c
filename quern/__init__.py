"""quern: a PySpark-native engine for document and web knowledge-graph analytics."""

__version__ = "0.1.0"
