"""Spark-native analytics over viewing histories."""
