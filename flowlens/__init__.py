"""flowlens: a PySpark-native engine for time-ordered network-flow analytics."""

__version__ = "0.1.0"
