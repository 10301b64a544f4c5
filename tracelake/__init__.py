"""Spark-native analytics over recorded agent executions."""
