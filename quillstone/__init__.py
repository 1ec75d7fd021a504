"""Spark-native analytics over labelled numeric vectors and training-data tables."""
