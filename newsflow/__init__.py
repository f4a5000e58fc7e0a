"""Spark-native news analytics: DataFrame in, DataFrame out."""
