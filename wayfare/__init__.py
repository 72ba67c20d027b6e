"""Spark-native analytics for scheduled trips, with operators for large text corpora beside them."""
