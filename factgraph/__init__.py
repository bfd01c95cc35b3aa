"""Spark-native analytics over code facts, execution traces and architecture models."""
