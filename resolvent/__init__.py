"""Spark-native engine that resolves compound names to identifiers and model species."""
