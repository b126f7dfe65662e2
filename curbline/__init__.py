"""Spark-native analytics for street-level imagery and street networks."""
