"""Spark-native document retrieval, retrieval evaluation and corpus processing."""
