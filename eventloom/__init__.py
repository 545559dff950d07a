"""Spark-native analytics for timestamped match, entity, series and payload data."""
