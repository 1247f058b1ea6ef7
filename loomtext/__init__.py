"""Spark-native text tokenization, sequence preparation and generation loops."""
