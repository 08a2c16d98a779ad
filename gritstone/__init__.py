"""Spark-native data quality, tabular analytics and training-data operators."""
