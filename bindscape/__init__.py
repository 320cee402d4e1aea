"""Spark-native analytics for protein-DNA binding experiments."""
