"""Spark-native preparation and tuning for machine-learning tables."""
