"""Spark-native entity resolution and corpus preparation."""
