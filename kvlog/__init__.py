"""Spark-native analytics over key-value command logs."""
