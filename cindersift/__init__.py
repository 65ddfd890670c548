"""cindersift: a Spark-native engine for security findings and corpus preparation."""

__version__ = "0.1.0"
