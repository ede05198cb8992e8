"""Spark-native retail analytics."""
