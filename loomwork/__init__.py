"""Spark-native orchestration analytics."""
