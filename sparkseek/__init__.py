"""Spark-native hybrid retrieval and analytics."""
