"""Spark-native engine for hierarchical time-series panels."""
