"""Spark-native analytics for networks of fixed sensors, and training-data operators."""
