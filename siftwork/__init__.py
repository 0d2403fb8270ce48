"""siftwork: a PySpark-native analytics engine for document opportunity mining."""

__version__ = "0.1.0"
