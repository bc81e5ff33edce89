"""A PySpark-native engine for Avro data."""

__version__ = "0.1.0"
