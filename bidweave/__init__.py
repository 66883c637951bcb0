"""Spark-native analytics for public-procurement opportunity intelligence."""
