"""A Spark-native engine for knowledge retrieval and retrieval evaluation."""

__version__ = "0.1.0"
