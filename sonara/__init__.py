"""Spark-native verification analytics and corpus preparation."""
