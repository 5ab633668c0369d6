"""Spark-native analytics for endpoint evidence: DataFrame in, DataFrame out."""
